"""Repeated lines against brute force, and the shape of the runs."""

from collections import Counter

from pyspark.sql import functions as F

from voltrail.llm import line_runs

SCHEMA = "doc_id long, text string, id string, row string, gone string, lines int, h1 long, batch int, kept string"
BLANKS = " \t\n\x0b\x0c\r"
A, B, C = "Same long line, in every one of the documents. Ä", "x" * 40, "y" * 39


def lowered(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, chars=40, docs=5):
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(lowered(line)) >= chars:
                holders.setdefault(lowered(line), set()).add(d)
    want = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(lowered(x), ())) < docs or d == max(holders[lowered(x)])]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return want


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "i", "r", "g", 1, 2, 3, "k") for d, t in rows], SCHEMA)


ROWS = [(i, f"own {i}\n{A}\n  {A.upper().replace('Ä', 'Ä')}\t\n\n{B if i % 4 else C}\nlast {'z' * 40}{i % 20}") for i in range(60)]
ROWS += [(100, None), (101, ""), (102, "\n"), (103, A), (103, A), (103, f"{B}\n{A}"), (None, A), (None, None), (104, f"{A}\r\n{A}\n"), (-5, f"{A}\n{C}"), (105, "\x0b" + B + " "),
         (106, "\n".join([A, "tail"] * 20000)), (59, ROWS[59][1])]


def test_lines_match_brute_force(spark):
    for rows in (ROWS, ROWS[:4], ROWS[:5], ROWS[60:63]):
        got = line_runs.deduplicated(frame(spark, rows)).collect()
        assert Counter(map(tuple, got)) == Counter(brute(rows))
    got = line_runs.deduplicated(frame(spark, ROWS), min_chars=5, min_docs=2, batches=3).collect()
    assert Counter(map(tuple, got)) == Counter(brute(ROWS, 5, 2))
    assert sum(r[2] for r in brute(ROWS)) > 100


def test_an_empty_table(spark):
    assert line_runs.deduplicated(frame(spark, [])).count() == 0


def test_runs_are_levelled_disjoint_and_merged_without_a_shuffle(spark, capsys, monkeypatch):
    monkeypatch.setattr(line_runs, "FAN", 2)
    index, seen = line_runs.new_index(spark), []
    for b in range(5):
        rows = [(100 * b + i, f"line {i + 7 * b} " + "q" * 40 + f"\nonly {b} {i} " + "w" * 40) for i in range(20)]
        batch = line_runs.occurrences(frame(spark, rows))
        if b == 1:
            own = line_runs.stage_buckets(batch.groupBy("h1", "h2").agg(F.count_distinct("id").alias("docs")), line_runs.HASH)
            line_runs.marked(own.withColumn("largest", F.lit(0)), index.runs).explain()
            plan = capsys.readouterr().out
            assert "Exchange" not in plan and "Sort [" not in plan and "SortMergeJoin" in plan
        index = line_runs.ingest(index, batch)
        seen.append(sorted(r.level for r in index.runs))
    assert seen == [[0], [1], [0, 1], [2], [0, 2]]
    rows = index.runs[0].lines.unionByName(index.runs[1].lines)
    assert rows.count() == rows.select("h1", "h2").distinct().count() == 100 + 20 + 4 * 7
    held = Counter(i + 7 * b for b in range(5) for i in range(20))
    assert line_runs.repeated(index, 3).count() == sum(n >= 3 for n in held.values())
