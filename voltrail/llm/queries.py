"""The named queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltrail.llm import (cover_tree, covering_simhash, decontaminate, hnsw, language_spans, line_runs, merkle_manifest, packing, partial_matching, quality, secret_ledger,
                          toxicity, window_dedup)
from voltrail.llm.common import LOWER, UPPER, held_out, remainder, ship, table
from voltrail.session import stage

#: Neighbouring rows of a file that op4 scores together.
ROWS_TOGETHER = 8192


def op1_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "toxic")
    out = held_out("doc_id", 5, 0)
    return toxicity.scored(docs, toxicity.fit(docs, labels, "toxic", ~out)).select(
        "doc_id", out.alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.neighbours").alias("neighbours"), F.col("toxicity.similarities").alias("similarities"))


def op2_neighbours(spark, folder):
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return hnsw.search(hnsw.build_index(rows), rows.filter("vec_id % 20 = 0"), k=20)


def op3_decontamination(spark, folder):
    docs, items = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")
    return decontaminate.contaminated(docs, items).drop("key")


def op4_language_model(spark, folder):
    docs = ship(spark).read.parquet(f"{folder.rstrip('/')}/documents.parquet").select(
        "doc_id", "text", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / ROWS_TOGETHER)).alias("block"))
    out = held_out("doc_id", 7, 2)
    scores = partial_matching.score(docs, ~out, block=F.col("block"))
    return scores.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op5_windows(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return window_dedup.deduplicated(docs).drop("kept")


def op6_language(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    out = held_out("doc_id", 5, 0)
    found = language_spans.labelled(docs.select("doc_id", "text"), language_spans.fit(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
                        F.size("language.spans").alias("n_spans"))


def op7_secrets(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = secret_ledger.by_path(docs, stage(secret_ledger.scan(docs), "ledger"))
    count = lambda rule: F.size(F.filter("findings", lambda f: f["rule"] == rule)).cast("long").alias(f"n_{rule}")
    base = F.filter("findings", lambda f: f["rule"].isin(*secret_ledger.BASE))
    return found.select("doc_id", *[count(r) for r in secret_ledger.BASE],
                        F.sha2(secret_ledger.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secret_ledger.listed("findings").alias("spans"))


def op8_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents", "doc_id", "text"))


def op9_simhash(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return covering_simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op10_quality(spark, folder):
    docs, labels = table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality")
    out = held_out("doc_id", 4, 2)
    return quality.scored(docs, quality.fit(docs, labels, "quality", ~out), to="score").select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_negatives(spark, folder):
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = rows.filter(whole).select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return cover_tree.mine(scaled, F.col("id") % 100 == 0)


def op12_manifest(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(remainder("doc_id", 5) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle_manifest.proofs(merkle_manifest.build(docs, shown={"text": tampered})).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_lines(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return line_runs.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def all_queries():
    return {f.__name__: f for f in (op1_toxicity, op2_neighbours, op3_decontamination, op4_language_model, op5_windows, op6_language, op7_secrets, op8_packing, op9_simhash,
                                    op10_quality, op11_negatives, op12_manifest, op13_lines)}


def _spans_sql() -> str:
    """The spans of all rules, found by cutting each text at its matches."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    each = [f"""
        SELECT doc_id, {rank} AS rank, '{r.name}' AS rule, unnest(regexp_extract_all(t, {quoted(r.pattern)}, 0)) AS m,
            unnest(regexp_extract_all(t, {quoted(r.pattern)}, {r.group})) AS part, unnest(range(1, len(regexp_extract_all(t, {quoted(r.pattern)}, 0)) + 1)) AS n,
            unnest(string_split_regex(t, {quoted(r.pattern)})[1:len(regexp_extract_all(t, {quoted(r.pattern)}, 0))]) AS before, {r.least} AS least
        FROM texts""" for rank, r in enumerate(secret_ledger.RULES)]
    return " UNION ALL ".join(each)


def _crc32(text: str) -> str:
    """crc32 of a short ASCII text in SQL, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}))"


def _manifest_sql() -> str:
    """Every source's list of nodes is reduced level by level; a leaf's siblings are cut from the lists of its levels."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    rise = "list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))"
    beside = "array_to_string(nodes[spot - spot % 16 + 1:spot], ''), array_to_string(nodes[spot + 2:spot - spot % 16 + 16], '')"
    return f"""
        WITH RECURSIVE hashed AS (
            SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0
                THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS shown
            FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS place FROM hashed),
        levels(source, level, nodes) AS (
            SELECT source, 0, list(leaf ORDER BY place) FROM placed GROUP BY source
            UNION ALL SELECT source, level + 1, {rise} FROM levels WHERE len(nodes) > 1),
        tops AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
        upper(level, nodes) AS (
            SELECT 0, list(subroot ORDER BY place) FROM tops UNION ALL SELECT level + 1, {rise} FROM upper WHERE len(nodes) > 1),
        walk(doc_id, leaf, shown, source, place, level, spot, proof, node) AS (
            SELECT doc_id, leaf, shown, source, place, 0, place, '', shown FROM placed
            UNION ALL SELECT doc_id, leaf, shown, source, place, level + 1, spot // 16, proof || lefts || rights, sha256(lefts || node || rights)
            FROM (SELECT w.*, unnest([struct_pack(lefts := x[1], rights := x[2])], recursive := true)
                  FROM (SELECT w.*, [{beside}] AS x FROM walk w JOIN levels l ON w.source IS NOT DISTINCT FROM l.source AND w.level = l.level AND len(nodes) > 1) w)),
        inner_ends AS (SELECT w.*, t.subroot, t.place AS tree FROM walk w JOIN tops t ON w.source IS NOT DISTINCT FROM t.source
                       JOIN (SELECT source, max(level) AS top FROM levels GROUP BY source) m ON w.source IS NOT DISTINCT FROM m.source AND w.level = m.top),
        climb(doc_id, leaf, subroot, level, spot, proof, node) AS (
            SELECT doc_id, leaf, subroot, 0, tree, proof, node FROM inner_ends
            UNION ALL SELECT doc_id, leaf, subroot, level + 1, spot // 16, proof || lefts || rights, sha256(lefts || node || rights)
            FROM (SELECT c.*, unnest([struct_pack(lefts := x[1], rights := x[2])], recursive := true)
                  FROM (SELECT c.*, [{beside}] AS x FROM climb c JOIN upper u ON c.level = u.level AND len(nodes) > 1) c))
        SELECT doc_id, leaf, subroot, r.nodes[1] AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.nodes[1] AS verified
        FROM climb c JOIN (SELECT * FROM upper WHERE len(nodes) = 1) r ON c.level = r.level"""


def statements():
    """SQL for DuckDB, where it can express a query."""
    counts = ", ".join(f"count(*) FILTER (WHERE rule = '{r}') AS n_{r}" for r in secret_ledger.BASE)
    base = ", ".join(f"'{r}'" for r in secret_ledger.BASE)
    one = "rule || ':' || (stop - length(m)) || ':' || stop, ',' ORDER BY stop - length(m), rank, stop"
    return {
        "op5_windows": r"""
            WITH trimmed AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM documents),
            split AS (SELECT doc_id, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(t, '[\x20\x09-\x0D]+') END AS ws FROM trimmed),
            windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM split, unnest(range(1, len(ws) - 48)) AS place(i)),
            marks AS (SELECT doc_id, i FROM windows JOIN (SELECT h, min(doc_id) AS least FROM windows GROUP BY h) USING (h) WHERE doc_id > least),
            words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM split),
            judged AS (SELECT w.doc_id, w.p, w.word, coalesce(max(m.i) OVER (PARTITION BY w.doc_id ORDER BY w.p) >= w.p - 49, false) AS gone
                       FROM words w LEFT JOIN marks m ON w.doc_id = m.doc_id AND w.p = m.i)
            SELECT doc_id, count(p) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
                sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM split LEFT JOIN judged USING (doc_id) GROUP BY doc_id""",
        "op7_secrets": f"""
            WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({_spans_sql()}),
            placed AS (SELECT *, CAST(sum(length(before) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY n) AS BIGINT) AS stop FROM found),
            good AS (SELECT * FROM placed WHERE length(part) >= least)
            SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}) FILTER (WHERE rule IN ({base})), '')) AS base_sha256,
                coalesce(string_agg({one}), '') AS spans
            FROM texts LEFT JOIN good USING (doc_id) GROUP BY doc_id""",
        "op11_negatives": """
            WITH good AS (
                SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            met AS (SELECT a.id AS anchor, hash(a.label, a.v) AS twin, b.id, b.label = a.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
                    FROM good a JOIN good b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
            positives AS (SELECT anchor, twin, id, score, row_number() OVER (PARTITION BY anchor, twin ORDER BY score DESC, id) AS place FROM met WHERE same),
            fits AS (SELECT p.*, n.id AS negative, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.twin, p.place ORDER BY n.score DESC, n.id) AS rank
                     FROM positives p JOIN met n USING (anchor, twin)
                     WHERE p.place <= 5 AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
            SELECT anchor AS anchor_id, id AS positive_id, rank, negative AS negative_id, score AS positive_score, negative_score
            FROM fits WHERE rank <= 10""",
        "op12_manifest": _manifest_sql(),
        "op13_lines": rf"""
            WITH split AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            lines AS (SELECT doc_id, r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM split),
            keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS k FROM lines),
            shared AS (SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
            judged AS (SELECT y.*, coalesce(doc_id < largest, false) AS gone FROM keyed y LEFT JOIN shared USING (k))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM judged GROUP BY r, doc_id""",
    }
