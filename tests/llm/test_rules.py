import re
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    n = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    return n | {"n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40,
    "a b c d e f g h i j\n" * 3 + "z\n\n  \nz", "é|è#  word x \U0001f600", "l1\nl1 \nl1\n" * 5,
    "p q r s t u v w " + "n1 n2 n3 " + "p q r s t u v w x y " + "q r s t u v w x y", "w%d " * 9 % tuple(range(9)), "long " * 30000,
]


def test_measurements_agree_with_brute_force(spark):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)] + [(None, "a b", None), (4, TEXTS[4], "other")]
    got = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert {k: r[k] for k in brute(text)} == brute(text), text


def test_windows_of_equal_hash_are_told_apart_by_their_words(spark, monkeypatch):
    """With a hash that maps everything to one value the words alone decide, also where equal ones do not stand together."""
    real = F.expr
    monkeypatch.setattr(rules.F, "expr", lambda s: real(re.sub(r"xxhash64\((\w)(, \w)?\)", "CAST(5 AS bigint)", s)))
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or len(t) < 10000]
    for r in rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert {k: r[k] for k in brute(TEXTS[r["doc_id"]])} == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_the_stored_ledger_serves_all_policies(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "\u65e5\u672c\u8a9e" * 20 + " " + " ".join("\u6f22\u5b57" * 10 + str(i) for i in range(25)))]
    inline = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    held = rules.stored(inline, f"{tmp_path}/ledger")
    assert held.schema.simpleString() == inline.schema.simpleString() and sorted(map(str, held.collect())) == sorted(map(str, inline.collect()))
    kept = {p: {r["doc_id"] for r in rules.apply_policy(held, rules.Policy(p)).where("kept").collect()} for p in rules.POLICIES}
    assert kept["v1"] <= kept["v2"] <= kept["base"] and 50 in kept["v2"] - kept["v1"]


def test_policies_and_ablations(spark):
    texts = ["good " + " ".join(f"w{i}x" for i in range(40)), "short", "*** " * 5 + " ".join(f"v{i}x" for i in range(30)), "rep " * 60]
    entries = rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(entries, rules.Policy("v1")).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}
    out = {r["rule"]: (r["failed"], r["failed_alone"]) for r in rules.ablations(entries, rules.Policy("v1")).collect()}
    assert out["few_words"] == (1, 1) and out["symbol_share"] == (1, 1) and out["repeated_windows"] == (1, 1)
    assert out["long_words"] == (0, 0)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rules.ledger(none).count() == 0
    assert {r["failed"] for r in rules.ablations(rules.ledger(none), rules.Policy("v1")).collect()} <= {0}


def test_columns_with_the_operators_own_names_survive(spark):
    names = ["_t", "_s", "_w", "_h", "_z", "_e", "_p", "_row", "_lines", "a`b c"]
    df = spark.createDataFrame([(*range(len(names)), "one two")], ", ".join(f"`{n.replace('`', '``')}` int" for n in names) + ", text string")
    (r,) = rules.ledger(df).collect()
    assert [r[n] for n in names[:-1]] == list(range(len(names) - 1)) and r["a`b c"] == len(names) - 1 and r["n_words"] == 2
    (r,) = rules.ledger(df.select("text")).collect()
    assert r["n_words"] == 2
