"""The same results in SQL over the tables as views. Text positions are bytes: the byte length of what stands before."""

from __future__ import annotations

from needlework.plans.queries import BATCH, CHUNK, PLACES, RANGE, SMALL_CHUNK


def quoted(x: bytes | str) -> str:
    text = x.decode() if isinstance(x, bytes) else x
    return "'" + text.replace("'", "''") + "'"


def places(pattern: bytes | str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``hit`` (key, pos): each occurrence, one character on from the last."""
    p = quoted(pattern)
    return f"""hit_c AS (
  SELECT {key}, CAST(instr({text}, {p}) AS BIGINT) AS c, {text} AS t FROM {table} WHERE instr({text}, {p}) > 0
  UNION ALL SELECT {key}, c + instr(substr(t, c + 1), {p}), t FROM hit_c WHERE instr(substr(t, c + 1), {p}) > 0),
hit AS (SELECT {key}, CAST(strlen(substr(t, 1, c - 1)) AS BIGINT) AS pos FROM hit_c)"""


def counts(pattern: bytes | str, text: str = "text") -> str:
    """Occurrences of a pattern that can't overlap itself."""
    return f"(len(string_split({text}, {quoted(pattern)})) - 1)"


def fold(chunk: int) -> str:
    """CTE ``seg``: the next-fit rule, a document a step."""
    cap = chunk - 1
    return f"""sized AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE strlen(text) > 0),
step AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS first_shard, CAST(0 AS BIGINT) AS first_used
  UNION ALL
  SELECT s.i, s.doc_id, s.n, x.at + x.whole, CASE WHEN x.whole > 0 THEN s.n - x.whole * {cap} ELSE x.here + s.n END, x.at, x.here
  FROM step p JOIN sized s ON s.i = p.i + 1,
  LATERAL (SELECT CASE WHEN p.used = {cap} OR (s.n > {cap} - p.used AND p.used > 0) THEN p.shard + 1 ELSE p.shard END AS at,
                  CASE WHEN p.used = {cap} OR (s.n > {cap} - p.used AND p.used > 0) THEN 0 ELSE p.used END AS here,
                  CASE WHEN s.n > {cap} THEN (s.n - 1) // {cap} ELSE 0 END AS whole) x),
cut AS (SELECT doc_id, n, first_shard, first_used, CASE WHEN n > {cap} THEN (n - 1) // {cap} ELSE 0 END AS whole FROM step WHERE i > 0),
pieces AS (SELECT *, unnest(range(0, whole + 1)) AS part FROM cut),
seg AS (SELECT CAST(first_shard + part AS INTEGER) AS shard_id, CAST(row_number() OVER (ORDER BY doc_id, part) - 1 AS BIGINT) AS ord, doc_id, CAST(part AS INTEGER) AS part_index,
  part = 0 AS is_first, part = whole AS is_last, CAST(part * {cap} AS BIGINT) AS doc_offset, CAST(CASE WHEN part < whole THEN {cap} ELSE n - whole * {cap} END AS BIGINT) AS len,
  CAST(CASE WHEN part = 0 AND whole = 0 THEN first_used ELSE 0 END AS BIGINT) AS shard_offset FROM pieces)"""


OFFSETS = """bound AS (SELECT doc_id, CAST(sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS BIGINT) AS start, CAST(sum(strlen(text)) OVER (ORDER BY doc_id) AS BIGINT) AS stop FROM documents)"""

#: documents as one text; hits of a pattern of two bytes within documents and over one end
CROSS = f"""{places(".L")}, {OFFSETS},
over AS (SELECT doc_id, CAST(strlen(text) - 1 AS BIGINT) AS pos FROM (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id) AS after FROM documents WHERE text <> '')
  WHERE text LIKE '%.' AND after LIKE 'L%'),
every AS (SELECT doc_id, pos FROM hit UNION ALL SELECT doc_id, pos FROM over)"""

#: hits of a pattern by the segment in which they begin
SEGMENT_HITS = "inside AS (SELECT s.*, h.pos FROM hit h JOIN seg s ON h.doc_id = s.doc_id AND h.pos >= s.doc_offset AND h.pos < s.doc_offset + s.len)"

#: documents end where shards go on: heads of what follows within the shard
TION_OVER = """ends AS (SELECT s.*, substr(hex(encode(d.text)), 2 * (s.doc_offset + greatest(s.len - 3, 0)) + 1, 2 * least(s.len, 3)) AS tail,
    substr(hex(encode(d.text)), 2 * s.doc_offset + 1, 2 * least(s.len, 3)) AS head FROM seg s JOIN documents d USING (doc_id)),
follow AS (SELECT *, substr(coalesce(lead(head, 1) OVER w, '') || coalesce(lead(head, 2) OVER w, '') || coalesce(lead(head, 3) OVER w, ''), 1, 6) AS after FROM ends WINDOW w AS (PARTITION BY shard_id ORDER BY ord)),
crossing AS (SELECT *, unnest(range(0, CAST(length(tail) / 2 AS BIGINT))) AS p FROM follow),
over AS (SELECT shard_id, ord, doc_id, is_last, CAST(shard_offset + len - length(tail) / 2 + p AS BIGINT) AS shard_pos, CAST(doc_offset + len - length(tail) / 2 + p AS BIGINT) AS doc_offset FROM crossing
  WHERE substr(tail || after, 2 * p + 1, 8) = '74696F6E' AND p + 4 > length(tail) / 2)"""



def tion_safe(chunk: int) -> str:
    return f"""{places("tion")}, {fold(chunk)}, {SEGMENT_HITS},
safe AS (SELECT shard_id, CAST(shard_offset + pos - doc_offset AS BIGINT) AS shard_pos, doc_id, pos AS doc_offset FROM inside WHERE pos + 4 <= doc_offset + len)"""


TION_SAFE = tion_safe(SMALL_CHUNK)

SUFFIX = """item AS (SELECT item_id, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n FROM benchmark WHERE text IS NOT NULL),
suf AS (SELECT item_id, n, h, sa, substr(h, 2 * sa + 1) AS s FROM (SELECT *, unnest(range(0, n + 1)) AS sa FROM item)),
sorted AS (SELECT item_id, n, h, sa, s, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s) - 1 AS BIGINT) AS row FROM suf),
bwt AS (SELECT item_id, sa, row, CASE WHEN sa = 0 THEN 0 ELSE CAST(('0x' || substr(h, 2 * sa - 1, 2)) AS BIGINT) END AS bwt FROM sorted)"""

HISTOGRAM = """hexed AS (SELECT hex(encode(text)) AS h FROM documents),
byte AS (SELECT substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS x FROM (SELECT h, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS i FROM hexed)),
histogram AS (SELECT CAST(('0x' || x) AS INTEGER) AS symbol, count(*) AS cnt FROM byte GROUP BY x)"""

GROUP = "SELECT doc_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM hit GROUP BY doc_id"


def recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def union_patterns() -> str:
    rows = []
    for name, p in BATCH.items():
        if p == b"ee":
            n = "coalesce((SELECT count(*) FROM hit h WHERE h.doc_id = d.doc_id), 0)"
        else:
            n = counts(p)
        rows.append(f"SELECT {quoted(name)} AS pattern, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE n > 0) AS n_docs FROM (SELECT {n} AS n FROM documents d)")
    return recursive(places("ee"), " UNION ALL ".join(rows))


ASKED = ", ".join(f"({p})" for p in PLACES)

SQL = {
    "count_pattern_per_doc": f"SELECT doc_id, CAST({counts('the ')} AS BIGINT) AS n FROM documents WHERE {counts('the ')} > 0",
    "count_overlapping": recursive(places("ee"), "SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id"),
    "count_total_doc_safe": f"SELECT CAST(sum({counts('the ')}) AS BIGINT) AS n FROM documents",
    "count_total": recursive(CROSS, "SELECT count(*) AS n FROM every"),
    "locate_doc_safe": recursive(places("the "), "SELECT doc_id, pos FROM hit"),
    "locate_multibyte": recursive(places("é"), "SELECT doc_id, pos FROM hit"),
    "locate_pages": recursive(places("</p>", "pages", "page_id", "html"), "SELECT page_id, pos FROM hit"),
    "conversation_hits": f"SELECT conv_id, role, CAST(sum({counts('tion')}) AS BIGINT) AS n FROM conversations WHERE {counts('tion')} > 0 GROUP BY conv_id, role",
    "locate_cross_doc": recursive(CROSS, "SELECT doc_id, pos, CAST(start + pos AS BIGINT) AS text_pos FROM every JOIN bound USING (doc_id)"),
    "cross_doc_only": recursive(CROSS, "SELECT doc_id, pos FROM over"),
    "doc_hits_count": recursive(places("the "), GROUP),
    "top_docs_by_hits": f"SELECT doc_id, CAST({counts('the ')} AS BIGINT) AS n FROM documents WHERE {counts('the ')} > 0 ORDER BY n DESC, doc_id LIMIT 10",
    "first5_preview": recursive(places("the "), "SELECT doc_id, pos FROM hit ORDER BY doc_id, pos LIMIT 5"),
    "batch_pattern_counts": union_patterns(),
    "benchmark_passage_lookup": """WITH RECURSIVE pair AS (SELECT doc_id, item_id, d.text AS t, b.text AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
found AS (SELECT doc_id, item_id, t, p, CAST(instr(t, p) AS BIGINT) AS c FROM pair
  UNION ALL SELECT doc_id, item_id, t, p, c + instr(substr(t, c + 1), p) FROM found WHERE instr(substr(t, c + 1), p) > 0)
SELECT doc_id, item_id, CAST(strlen(substr(t, 1, c - 1)) AS BIGINT) AS pos FROM found""",
    "hits_by_lang": f"SELECT lang, CAST(sum({counts('tion')}) AS BIGINT) AS n, count(*) FILTER (WHERE {counts('tion')} > 0) AS n_docs FROM documents GROUP BY lang",
    "hits_by_source": f"SELECT source, CAST(sum({counts('the ')}) AS BIGINT) AS n, count(*) FILTER (WHERE {counts('the ')} > 0) AS n_docs FROM documents GROUP BY source",
    "doc_offsets": f"WITH {OFFSETS} SELECT doc_id, start, stop FROM bound",
    "pos_to_doc": f"""WITH {OFFSETS}, asked(pos) AS (SELECT CAST(x AS BIGINT) FROM (VALUES {ASKED}) v(x) UNION ALL SELECT max(stop) + d FROM bound, (VALUES (0), (1), (11)) e(d) GROUP BY d)
SELECT pos, doc_id, CAST(pos - start AS BIGINT) AS doc_offset FROM asked JOIN bound ON (pos >= start AND pos < stop) OR (pos = stop AND stop = (SELECT max(stop) FROM bound) AND start < stop)""",
    "extract_snippet": "SELECT doc_id, substr(hex(encode(text)), 21, 80) AS snippet FROM documents",
    "get_document_digest": "SELECT doc_id, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS len FROM documents WHERE strlen(text) > 0",
    "shard_plan": recursive(fold(CHUNK), "SELECT shard_id, count(*) AS n_segments, CAST(sum(len) AS BIGINT) AS n_bytes, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM seg GROUP BY shard_id"),
    "segment_table": recursive(fold(SMALL_CHUNK), "SELECT shard_id, ord, doc_id, part_index, is_first, is_last, doc_offset, len, shard_offset FROM seg"),
    "sharded_locate": recursive(f"{TION_SAFE}, {TION_OVER}", "SELECT * FROM safe UNION ALL SELECT shard_id, shard_pos, doc_id, doc_offset FROM over"),
    "sharded_locate_doc_safe": recursive(TION_SAFE, "SELECT shard_id, shard_pos, doc_id, doc_offset FROM safe"),
    "merged_locate_doc_safe": recursive(places("the "), "SELECT doc_id, pos FROM hit"),
    "merged_locate": recursive(f"{TION_SAFE}, {TION_OVER}", "SELECT doc_id, pos FROM hit UNION ALL SELECT doc_id, doc_offset FROM over WHERE is_last"),
    "merged_counts": f"SELECT CAST(sum({counts('the ')}) AS BIGINT) AS n FROM documents",
    "sharded_counts": recursive(f"{TION_SAFE}, {TION_OVER}", "SELECT 'shards' AS kind, (SELECT count(*) FROM safe) + (SELECT count(*) FROM over) AS n UNION ALL SELECT 'doc_safe', count(*) FROM safe"),
    "seam_hits_only": recursive(f"{places('the ')}, {fold(SMALL_CHUNK)}, {SEGMENT_HITS}", "SELECT doc_id, pos FROM inside WHERE pos + 4 > doc_offset + len"),
    "symbol_histogram": f"WITH {HISTOGRAM} SELECT symbol, cnt FROM histogram",
    "c_table": f"WITH {HISTOGRAM} SELECT symbol, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c_start FROM histogram",
    "suffix_array_small": f"WITH {SUFFIX} SELECT item_id, row, sa FROM sorted",
    "bwt_small": f"WITH {SUFFIX} SELECT item_id, row, bwt FROM bwt",
    "lf_small": f"WITH {SUFFIX} SELECT b.item_id, b.row, a.row AS lf FROM bwt b JOIN bwt a ON a.item_id = b.item_id AND a.sa = CASE WHEN b.sa = 0 THEN (SELECT max(m.sa) FROM bwt m WHERE m.item_id = b.item_id) ELSE b.sa - 1 END",
    "interval_sp_ep": f"""WITH {SUFFIX}, asked(pattern) AS (VALUES ('th'), ('e'), ('on '), ('zz'), ('')),
n AS (SELECT item_id, pattern, count(*) FILTER (WHERE s < hex(encode(pattern))) AS below, count(*) FILTER (WHERE starts_with(s, hex(encode(pattern)))) AS hits FROM sorted, asked GROUP BY item_id, pattern)
SELECT item_id, pattern, CAST(CASE WHEN hits = 0 THEN 1 ELSE below END AS BIGINT) AS sp, CAST(CASE WHEN hits = 0 THEN 0 ELSE below + hits - 1 END AS BIGINT) AS ep FROM n""",
    "rank_small": f"WITH {SUFFIX} SELECT item_id, count(*) FILTER (WHERE bwt = 101 AND row < 50) AS n FROM bwt GROUP BY item_id",
    "resolve_small": f"WITH {SUFFIX} SELECT item_id, 'sa' AS kind, row AS asked, sa AS found FROM sorted WHERE row IN (0, 32, 64) UNION ALL SELECT item_id, 'isa', sa, row FROM sorted WHERE sa IN (0, 32, 64)",
    "rank_every_small": f"WITH {SUFFIX} SELECT item_id, bwt AS symbol, row + 1 AS row, count(*) OVER (PARTITION BY item_id, bwt ORDER BY row) AS n FROM bwt",
    "resolve_every_small": f"WITH {SUFFIX} SELECT item_id, 'sa' AS kind, row AS asked, sa AS found FROM sorted UNION ALL SELECT item_id, 'isa', sa, row FROM sorted",
    "index_stats": recursive(fold(CHUNK), "SELECT shard_id, CAST(sum(len) + 1 AS BIGINT) AS text_len, count(DISTINCT doc_id) AS n_docs, count(*) AS n_segments, CAST(ceil((sum(len) + 1) / 32) AS BIGINT) AS n_samples FROM seg GROUP BY shard_id"),
    "ingest_totals": recursive(
        fold(CHUNK),
        "SELECT count(*) AS n_shards, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(max(b) AS BIGINT) AS largest_shard, CAST(sum(s) AS BIGINT) AS n_segments, (SELECT count(DISTINCT doc_id) FROM seg) AS n_docs FROM (SELECT shard_id, sum(len) AS b, count(*) AS s FROM seg GROUP BY shard_id)",
    ),
    "locate_repeated_ids": recursive(places("tion", "conversations", "conv_id"), "SELECT conv_id, pos FROM hit"),
    "locate_binary": recursive(places("é"), "SELECT doc_id, pos FROM hit"),
    "locate_one_byte": recursive(places("q"), "SELECT doc_id, pos FROM hit"),
    "count_empty_pattern": recursive(fold(CHUNK), "SELECT CAST(sum(len) + count(DISTINCT shard_id) AS BIGINT) AS n FROM seg"),
    "extract_range": recursive(
        fold(CHUNK),
        f"""SELECT shard_id, string_agg(substr(hex(encode(text)), CAST(2 * (doc_offset + greatest({RANGE[0]} - shard_offset, 0)) + 1 AS BIGINT), CAST(2 * (least({sum(RANGE)} - shard_offset, len) - greatest({RANGE[0]} - shard_offset, 0)) AS BIGINT)), '' ORDER BY ord) AS slice
FROM seg JOIN documents USING (doc_id) WHERE shard_offset < {sum(RANGE)} AND shard_offset + len > {RANGE[0]} GROUP BY shard_id""",
    ),
    "locate_indexed": recursive(f"{tion_safe(CHUNK)}, {TION_OVER}", "SELECT shard_id, shard_pos FROM safe UNION ALL SELECT shard_id, shard_pos FROM over"),
    "count_indexed": recursive(f"{tion_safe(CHUNK)}, {TION_OVER}", "SELECT shard_id, count(*) AS n FROM (SELECT shard_id FROM safe UNION ALL SELECT shard_id FROM over) GROUP BY shard_id"),
    "access_small": f"WITH {SUFFIX} SELECT item_id, bwt FROM bwt WHERE row = 2",
    "doc_hits_listed": recursive(places("tion"), "SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, count(*) AS n FROM hit GROUP BY doc_id"),
    "concatenated_documents": """WITH numbered AS (SELECT text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, encode(text)) - 1 AS doc_ordinal FROM conversations WHERE text IS NOT NULL)
SELECT CAST(doc_ordinal AS BIGINT) AS doc_ordinal, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, min(md5(text)) AS digest FROM numbered GROUP BY 1""",
    "shard_sizes": recursive(
        fold(CHUNK),
        "SELECT shard_id, n_bytes, CASE WHEN n_bytes >= 1048576 THEN printf('%.2f MiB', n_bytes / 1048576) WHEN n_bytes >= 1024 THEN printf('%.2f KiB', n_bytes / 1024) ELSE printf('%d B', n_bytes) END AS shown FROM (SELECT shard_id, CAST(sum(len) AS BIGINT) AS n_bytes FROM seg GROUP BY shard_id)",
    ),
}
