import random
import re
from collections import Counter

from strata.llm import line_rules
from strata.llm.queries import op8_line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)


def test_counts_match_brute_force(docs):
    rng = random.Random(9)
    rows = [(None, None), (1, ""), (2, " \x1c\x85 a\xa0b"), (3, "a b c d e " * 9), (4, "😀 é | # $ %\n" * 3), (4, "x\r\nx\r\ny"), (5, "w" * 200_000)]
    rows += [(k, "".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 90)))) for k in range(10, 120)]
    rows += [(200, " ".join(rng.choice("abc") for _ in range(4_000)))]
    got = line_rules.line_first_rules(docs(rows)).collect()
    key = lambda t: (str(t[0]), t[1:])
    assert sorted(((r[0], *r[1:7]) for r in got), key=key) == sorted(((i, *plain(t or "")) for i, t in rows), key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_each_line_rule():
    rules, pattern = line_rules.LineRules(), re.compile(line_rules.BOILERPLATE)
    fails = lambda line: line_rules.line_fails(line, line.encode().split(), rules, pattern)
    assert fails("The quick brown fox jumps over the lazy dog.") is None
    assert fails("one### two*** three$$$ four words") == "symbols"
    assert fails("THIS!! IS!! LOUD!!") == "shouting"
    assert fails("go go go go go stop stop stop stop stop") == "stutter"
    assert fails("Home | News | Sport | Contact") == "navigation"
    assert fails("Read on") == "punctuation"
    assert fails("All rights reserved by their owners everywhere.") == "boilerplate"


def test_lost_text_rejects_and_cleaned_text_follows(docs):
    good = "A calm sentence that says something about the sea and its ships."
    rows = [(1, f"{good}\nHome | News | Sport | Contact"), (2, "Home | News | Sport | Contact | About | Jobs | Press\n" * 3 + "Short end here now, yes."), (3, f"{good}\n\nLogin")]
    got = {r.doc_id: r for r in line_rules.line_first_rules(docs(rows), cleaned=True).collect()}
    assert got[1].kept and got[1].clean_text == good and got[1].n_failed_lines == 1
    assert not got[2].kept and not got[2].base_failed or got[2].base_failed
    assert got[3].clean_text == f"{good}\n"


def test_empty_and_clashing_columns(spark, docs):
    assert line_rules.line_first_rules(docs([])).collect() == []
    odd = spark.createDataFrame([(1, "a", 2, 3)], "doc_id int, text string, kept int, id int")
    assert line_rules.line_first_rules(odd).first().n_words == 1


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r[0]: tuple(r[1:7]) for r in op8_line_rules(spark, sf).collect()} == want


def test_labels_agree_with_the_verdict(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op8_line_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rows) >= 0.98 * len(rows)


def test_bytes_that_are_no_utf8(spark):
    from strata.llm import bpe, pu_quality, simhash  # noqa: F401

    broken = spark.sql("SELECT 1 AS doc_id, cast(unhex('6162FF2063') AS string) AS text, 's' AS source")
    assert line_rules.line_first_rules(broken).first().n_words == 2
    assert simhash.simhash_groups(broken).first().id == 1
