import hashlib
import random

from strata.llm.line_spread import line_spread_report, remove_spread_lines
from strata.llm.queries import op10_line_spread

BLANK = " \t\n\x0b\x0c\r"


def plain(rows, sources, min_sites):
    spread = {}
    for (_, text), source in zip(rows, sources):
        for line in (text or "").split("\n"):
            if line.strip(BLANK):
                spread.setdefault(line.strip(BLANK), set()).add(source or "")
    out = []
    for i, text in rows:
        text = text or ""
        lines = text.split("\n")
        hit = [len(spread.get(x.strip(BLANK), ())) >= min_sites for x in lines]
        left = "\n".join(x for x, h in zip(lines, hit) if not h)
        removed = any(hit) and left.strip(BLANK) != ""
        left = left if removed else text
        out.append((i, sum(bool(x.strip(BLANK)) for x in lines), sum(hit), sum(hit) if removed else 0, len(left), hashlib.sha256(left.encode()).hexdigest(), left))
    return out


def corpus():
    rng = random.Random(11)
    shared = [f"shared line number {k}" for k in range(12)]
    rows, sources = [(None, None), (1, ""), (2, "\n \n\t"), (2, "only\n\n"), (3, "x" * 100_000)], ["a", None, "b", "b", "c"]
    for k in range(10, 220):
        lines = [f"own text of document {k} part {j}, long enough" for j in range(rng.randint(1, 5))]
        lines += [rng.choice(["", "  "]) + rng.choice(shared[: 1 + k % 12]) for _ in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
        sources.append(rng.choice([None, *(f"s{j}" for j in range(3 + k % 9))]))
    rows += [rows[20]] * 3
    sources += ["s0", "s1", sources[20]]
    return rows, sources


def test_report_and_removal_match_brute_force(docs):
    rows, sources = corpus()
    for min_sites in (2, 6, 9):
        want = plain(rows, sources, min_sites)
        assert any(w[3] for w in want)
        got = line_spread_report(docs(rows, sources), min_sites=min_sites).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted((w[:6] for w in want), key=str)
        kept = remove_spread_lines(docs(rows, sources), min_sites=min_sites).collect()
        assert sorted(((r.doc_id, r.text or "") for r in kept), key=str) == sorted(((w[0], w[6]) for w in want), key=str)


def test_empty_and_clashing_columns(spark, docs):
    assert line_spread_report(docs([])).collect() == [] == remove_spread_lines(docs([])).collect()
    odd = spark.createDataFrame([(1, "a", "s", 2, 3)], "doc_id int, text string, source string, drop int, h int")
    assert [tuple(r) for r in remove_spread_lines(odd).collect()] == [(1, "a", "s", 2, 3)]
    assert line_spread_report(odd).first().n_lines == 1


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    found = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain([f[:2] for f in found], [f[2] for f in found], 10)
    assert sorted(tuple(r) for r in op10_line_spread(spark, sf).collect()) == sorted(w[:6] for w in want)


def test_many_spread_lines_in_a_long_text(docs):
    shared = [f"shared {k}" for k in range(20_000)]
    own = [f"the only copy of line {k} in all of the texts" for k in range(20_000)]
    mixed = [x for pair in zip(own, shared) for x in pair]
    rows = [(1, "\n".join(mixed)), *((k, "\n".join(shared)) for k in range(2, 4))]
    got = {r.doc_id: r for r in line_spread_report(docs(rows, ["a", "b", "c"]), min_sites=3).collect()}
    assert (got[1].n_spread, got[1].n_removed, got[1].n_chars_left) == (20_000, 20_000, len("\n".join(own)))
    assert (got[2].n_spread, got[2].n_removed) == (20_000, 0)


def test_a_given_loss_exempts_texts_that_would_lose_more(docs):
    rows = [(k, f"a line that stands on all of the sites\nown {k}") for k in range(3)]
    assert {r.n_removed for r in line_spread_report(docs(rows, ["a", "b", "c"]), min_sites=3, max_loss=0.5).collect()} == {0}
    assert {r.n_removed for r in line_spread_report(docs(rows, ["a", "b", "c"]), min_sites=3).collect()} == {1}
