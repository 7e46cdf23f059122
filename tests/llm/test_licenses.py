import random
import re

import pytest

from lodestone.llm import license_texts, licenses
from lodestone.llm.licenses import TEMPLATES, Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = [(t.label, t.text.split()) for t in TEMPLATES if t.base]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    hits = [(i, label) for label, p in BASE for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


NOTICE = TEMPLATES[3].text
TEXTS = [
    None, "", "...", "one", "two words", "Released UNDER the  MIT-License, v2", "cc-by-nc cc by nc", "cc by cc by nc nc by", "Apache License, Version 2.0", "under the mit",
    "the mit license under", "UNDER the MİT license", "under the mit licenſe", "x under the mit license " * 40, "é under the mit license cc by nc", "pad " * 30000 + "cc by nc",
    "apache license version 2 under the mit license", NOTICE.replace("hereby ", "hereby now "), NOTICE.replace("charge", "cost"), " ".join(NOTICE.split()[:8]),
]


def test_base_places_agree_with_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, "cc by nc"), (5, TEXTS[5]), (5, "other text"), (None, None)]
    got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, label string").repartition(3)).collect()
    have = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str)
    assert have == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


@pytest.mark.parametrize(("text", "least"), [(NOTICE, 1.0), ("we say: " + NOTICE.replace("hereby", "now hereby also") + " and so on", 0.8), (NOTICE.replace("charge", "cost"), 0.9)])
def test_passages_with_changed_words_are_found(spark, text, least):
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r["labels"], r["base_labels"], r["n_base"]) == ("mit", "", 0) and least <= r["score"] <= 1
    assert words(text)[r["spans"][0]["first"]] in ("permission", "granted")  # where the first whole k-gram stands


def test_a_part_of_a_notice_is_no_passage(spark):
    (r,) = licenses.scan(spark.createDataFrame([(1, " ".join(NOTICE.split()[:8]))], "doc_id long, text string")).collect()
    assert (r["labels"], r["score"]) == ("", 0.0)


def test_empty_and_bad_templates(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(none).count() == 0
    with pytest.raises(ValueError, match="3 words or more"):
        licenses.template_table(spark, (Template("x", "two words"),))


def runs(flags):
    """Starts of K matching words in a row."""
    return [i for i in range(len(flags) - licenses.K + 1) if all(flags[i : i + licenses.K])]


def brute_scan(text, templates):
    """Every diagonal word by word: (labels, score, spans) as the scan defines them."""
    w, spans, labels, score = words(text), [], set(), 0.0
    for number, t in enumerate(templates):
        p, found = words(t.text), []
        for diagonal in range(-len(p) + 1, len(w)):
            flags = [0 <= diagonal + i < len(w) and w[diagonal + i] == x for i, x in enumerate(p)]
            parts = {i // licenses.PART for i in runs(flags)}
            if parts:
                found.append((diagonal, {i for i, f in enumerate(flags) if f and i // licenses.PART in parts}))
        while found:
            group = [found.pop(0)]
            while found and found[0][0] - group[-1][0] <= licenses.NEIGHBOURS:
                group.append(found.pop(0))
            hit = set().union(*(h for _, h in group))
            barred = False
            if t.bars:
                first, *rest = t.bars.split()
                at = p.index(first)
                barred = any(0 <= d + at < len(w) - 1 and w[d + at] == first and w[d + at + 1] in rest for d, _ in group)
            if t.base:
                full = [d for d, h in group if len(h) == len(p)]
                if not full:
                    continue
                first, last = min(full), max(full)
            else:
                if len(hit) < licenses.COVERAGE * len(p) or barred or any(x in t.needs.split() and i not in hit for i, x in enumerate(p)):
                    continue
                first = min(d + part for d, h in group for part in [min(h)])
                last = group[-1][0]
            labels.add(t.label)
            score = max(score, len(hit) / len(p))
            spans.append((number, first, last + len(p) - 1, len(hit) / len(p)))
    return ",".join(sorted(labels)), score, sorted(spans)


LONG = Template("long", " ".join(f"w{i * 7 % 211} x{i % 5}" for i in range(150)), needs="w7")
SOME = (*TEMPLATES, LONG, Template("base-long", " ".join(f"b{i}" for i in range(130)), True))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = rng.choice([[], ["new"], ["two", "more"]])
    return " ".join(w)


def test_labels_spans_and_scores_agree_with_brute_force(spark):
    rng = random.Random(7)
    texts = [t for t in TEXTS if t is None or len(t) < 5000] + [t.text for t in SOME]
    for t in SOME:
        texts += [edited(rng, t.text, n) for n in (1, 3, 9)]
        texts.append("before " + t.text + " between " + edited(rng, rng.choice(SOME).text, 2))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), SOME).collect()}
    for i, t in enumerate(texts):
        labels, score, spans = brute_scan(t, SOME)
        assert got[i]["labels"] == labels, t
        assert abs(got[i]["score"] - score) < 1e-9
        assert [(s["template"], s["first"], s["last"]) for s in got[i]["spans"]] == [s[:3] for s in spans]
        assert all(abs(a["coverage"] - b[3]) < 1e-9 for a, b in zip(got[i]["spans"], spans, strict=True))


def test_whole_licenses_are_found_as_one_passage(spark):
    docs = spark.createDataFrame([(i, f"Copyright 2020 X\n{text}\nmore") for i, (_, text) in enumerate(license_texts.WHOLE)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        label, text = license_texts.WHOLE[r["doc_id"]]
        assert r["labels"] == label and r["score"] == 1
        assert any(s["last"] - s["first"] + 1 == len(words(text)) for s in r["spans"])
