import random

from draftsmith.llm.lines import dedup_lines
from tests.llm.helpers import docs_frame, long_text


def plain(rows, min_words):
    """Brute force: every stretch of lines that reaches ``min_words`` words."""
    places, stretches, out = {}, [], {}
    for d, text in rows:
        lines = text.split("\n")
        solid = [(i, x.strip(), len(x.split())) for i, x in enumerate(lines) if x.strip()]
        for a in range(len(solid)):
            for b in range(a, len(solid)):
                if sum(w for _, _, w in solid[a : b + 1]) >= min_words:
                    key = tuple(x for _, x, _ in solid[a : b + 1])
                    stretches.append((d, solid[a][0], solid[b][0], key))
                    places.setdefault(key, []).append((d, solid[a][0], solid[b][0]))
    for d, text in rows:
        out[d] = set()
    for d, s, e, key in stretches:
        fd, _, fe = min(places[key])
        if d > fd or s > fe:
            out[d].update(range(s, e + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out[d]) for d, t in rows}


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(12)] + ["", "  "]
    rows = []
    for d in range(60):
        rows.append((d, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))))
    run = "\n".join(pool[:5])
    rows += [(100, f"x1 x2\n{run}\ny1"), (101, f"z z z\n{run}\nq"), (102, f"{run}\n{run}")]
    want = plain(rows, 8)
    got = dedup_lines(docs_frame(spark, rows), min_words=8).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert any(r.cut_lines for r in got)


def test_first_place_stays_and_runs_extend(spark):
    a, b = long_text(60), "short line"
    rows = [(1, f"{a}\n{b}"), (2, f"start\n{b}\n{a}\n{b}\nend"), (3, f"{b}\nother")]
    got = {r.doc_id: (r.text, r.cut_lines) for r in dedup_lines(docs_frame(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"start\n{b}\nend", 2), 3: (rows[2][1], 0)}


def test_edges(spark):
    a = long_text(55)
    rows = [(1, None), (2, ""), (3, a), (3, a), (None, a), (4, "\n".join([a] * 3)), (5, "\n".join(f"l{i} m n" for i in range(20_000))), (6, "w " * 100_000), (7, f"  {a}\t\n\n")]
    docs = docs_frame(spark, rows, extra=True)
    out = dedup_lines(docs)
    assert [c for c in out.columns if c != "cut_lines"] == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(rows)
    assert (1, None) in got and (2, "") in got
    assert (None, a) in got  # a null id sorts first, so it holds the first place
    assert got.count((3, "")) == 2 and (4, "") in got and (7, "\n") in got
    assert dict(got)[5] == rows[6][1] and dict(got)[6] == rows[7][1]
    assert dedup_lines(docs.limit(0)).count() == 0
