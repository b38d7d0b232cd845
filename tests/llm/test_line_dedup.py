import random

from tests.llm.conftest import rows_of
from voxframe.llm import line_dedup as D


def brute(rows, min_lines=2, min_chars=200):
    """Later copies of windows of ``min_lines`` lines and of single long lines, in order of doc_id."""
    spoken = {k: [x for x in (t or "").split("\n") if x.strip(" \t\n\r\v\f")] for k, t in rows}
    gone, seen, long = set(), set(), set()
    for k in sorted(spoken):
        lines = spoken[k]
        for i in range(len(lines) - min_lines + 1):
            window = tuple(lines[i : i + min_lines])
            if window in seen:
                gone |= {(k, i + d) for d in range(min_lines)}
            seen.add(window)
        for i, x in enumerate(lines):
            if len(x) >= min_chars:
                if x in long:
                    gone.add((k, i))
                long.add(x)
    out = []
    for k, t in rows:
        if t is None:
            out.append((k, None))
            continue
        kept, i = [], 0
        for x in t.split("\n"):
            if x.strip(" \t\n\r\v\f"):
                if (k, i) not in gone:
                    kept.append(x)
                i += 1
            else:
                kept.append(x)
        out.append((k, "\n".join(kept)))
    return sorted(out, key=repr)


def test_random_lines_against_brute_force(make):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", "x" * 250, "d"]) for _ in range(rng.randint(0, 12)))) for k in range(40)]
    for n in (2, 3, 4):
        assert rows_of(D.dedup_lines(make(rows), min_lines=n), "doc_id", "text") == brute(rows, n)


def test_nulls_empty_repeated_rows_and_clashing_columns(make):
    rows = [(1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "zero\none\ntwo"), (4, "zero\none\ntwo"), (None, "two\nthree"), (5, " \n\t\n")]
    out = D.dedup_lines(make(rows, extra=True))
    got = rows_of(out, "doc_id", "text", "node", "form", "lines_removed")
    # the row without doc_id is first in order, so it keeps its run
    assert (None, "two\nthree", "aNone", "cNone", 0) in got
    assert (1, "one", "a1", "c1", 2) in got
    assert (2, None, "a2", "c2", 0) in got and (3, "", "a3", "c3", 0) in got and (5, " \n\t\n", "a5", "c5", 0) in got
    assert got.count((4, "zero", "a4", "c4", 2)) == 2


def test_empty_table(make):
    assert D.dedup_lines(make([])).count() == 0


def test_names_of_added_columns(make):
    out = D.dedup_lines(make([(1, "a")], extra=True), before="n", removed="score")
    assert rows_of(out, "n", "score") == [(1, 0)]


def test_suffix_array_orders_all_suffixes(make):
    """Ranks follow the lexical order of the sequences of line ids; equal ranks are suffixes equal to their end."""
    rng = random.Random(5)
    docs = make([(k, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for k in range(25)])
    ids = {}
    for r in D.line_ids(docs).collect():
        ids[r.doc_id, r.seq] = (r.k1, r.k2)
    array, _ = D.suffix_array(docs)
    ranks = {(r.doc_id, r.seq): r["rank"] for r in array.collect()}
    suffix = {at: [ids[at[0], k] for k in range(at[1], 99) if (at[0], k) in ids] for at in ids}
    order = sorted(suffix.values())
    for at, own in suffix.items():
        assert ranks[at] == 1 + order.index(own)


def test_long_run_of_one_line_in_one_document(make):
    text = "\n".join(["again"] * 5000)
    assert rows_of(D.dedup_lines(make([(1, text)])), "text", "lines_removed") == [("again", 4999)]


def test_repeated_rows_are_one_sequence(make):
    rows = [(1, "A\nB"), (1, "A\nB"), (2, "A\nC"), (2, "A\nC"), (3, "A\nA\nD"), (None, "B\nE"), (None, "B\nE")]
    assert rows_of(D.dedup_lines(make(rows)), "doc_id", "text") == sorted(rows, key=repr)
    run = [(1, "p\nq\nr"), (1, "p\nq\nr"), (2, "o\np\nq\nr"), (2, "o\np\nq\nr")]
    assert rows_of(D.dedup_lines(make(run), min_lines=3), "doc_id", "text") == [(1, "p\nq\nr")] * 2 + [(2, "o")] * 2


def test_doubling_goes_on_until_ties_end_and_gives_maximal_runs(make):
    """A run of 37 lines that ends before its document does, a copy of a whole text, a long line, and what is nowhere else."""
    run = [f"line {i}" for i in range(37)]
    long = "x" * 250
    rows = [(1, run + ["one", long]), (2, ["two", *run, "three", long, "four"]), (3, ["two", *run, "three", long, "four"]), (4, ["five", "six"])]
    found, depth = D.repeated_runs(make([(k, "\n".join(t)) for k, t in rows]))
    # document 3 is equal to 2 up to its end, all 41 lines
    assert rows_of(found, "doc_id", "start", "n_lines") == [(2, 1, 37), (2, 39, 1), (3, 0, 41)]
    assert depth == 64


def test_runs_of_single_lines_of_any_length(make):
    rows = [(1, "a\nb"), (2, "c\na\nd")]
    assert rows_of(D.dedup_lines(make(rows), min_lines=1), "doc_id", "text") == brute(rows, 1)


def test_plans_do_not_grow_with_the_rounds(make):
    """What the rounds found is read back, not joined and sorted again in one plan for all depths."""
    plans = []
    for lines in (3, 70):
        same = "\n".join(f"line {i}" for i in range(lines))
        found, _ = D.repeated_runs(make([(1, same), (2, same)]))
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        assert rows_of(found, "doc_id", "start", "n_lines") == [(2, 0, lines)]
    shallow, deep = [{x: p.count(x) for x in ("Join", "Aggregate", "Window")} for p in plans]
    assert shallow == deep == {"Join": 0, "Aggregate": 1, "Window": deep["Window"]}
