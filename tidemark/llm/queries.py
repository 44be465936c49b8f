"""The operators' queries over the given tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.conversation_repair import Repair
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.licenses import scanned
from tidemark.llm.ngram_join import linked_components
from tidemark.llm.packing import packed_documents
from tidemark.llm import personal_data as pii
from tidemark.llm.personal_data import listed, personal_data
from tidemark.llm.periodic_runs import periodic_runs
from tidemark.llm.quality import fit, scored
from tidemark.llm.quotations import reply_ordered
from tidemark.llm.repair_store import read_tokens, write_tokens
from tidemark.llm.suffix_dedup import without_repeats
from tidemark.llm.topk_search import top_k
from tidemark.llm.url_filter import judged
from tidemark.operators.staging import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark, sf_dir):
    out = decontaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL["op1_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, s + 1, s + 13), ' ') AS t
  FROM b, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS u(s) WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT k FROM win
), dwin AS (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s + 1, s + k), ' ') AS t
  FROM d, lengths, unnest(range(0, len(w) - k + 1)) AS u(s)
), hit AS (
  SELECT doc_id, k, s, item_id FROM dwin JOIN win USING (k, t)
), spots AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query
def op4_ngram_jaccard(spark, sf_dir):
    return linked_components(read(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark, sf_dir):
    return without_repeats(read(spark, sf_dir, "documents")).drop("kept", "carried")


@query
def op2_quotation_linking(spark, sf_dir):
    return reply_ordered(read(spark, sf_dir, "conversations"))


@query
def op3_token_store(spark, sf_dir):
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return read_tokens(spark, path, crc_only=True)


@query
def op5_license_scan(spark, sf_dir):
    return scanned(read(spark, sf_dir, "documents"))


def quality_model(spark, docs, sf_dir):
    """Fitted on the rows of ``docs`` with a label, outside the held-out fold."""
    return fit(docs, read(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op6_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = scored(docs, quality_model(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The rules of the contract.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query
def op7_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL["op7_url_filter"] = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages
), r(h, p, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path,
  (SELECT arg_max(h || r.p, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS rule,
  coalesce((SELECT arg_max(verdict, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)), 'allow') AS verdict
FROM p
"""


@query
def op8_topk_search(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"))


SQL["op8_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op10_vector_packing(spark, sf_dir):
    return packed_documents(read(spark, sf_dir, "documents"), tokenizer())


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the contract's periods written into a tenth of the texts, by the document's id; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(
        "doc_id", "text", F.floor(h / 10).alias("g"),
        F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"),
    ).withColumn("n", F.coalesce(F.size("w"), F.lit(-1)))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    period = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get(
        "w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(period, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("top", longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"), F.expr("1000 * top.n div -top.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 of short ASCII texts: ``t`` is its table of 256 remainders.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) AS r(i)
)"""


def _crc_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)")


SQL["op12_periodic_runs"] = rf"""
WITH {_CRC_TABLE}, base AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0,
    CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc_sql("doc_id::VARCHAR")} END AS h FROM documents, crc_table
), spot AS (
  SELECT *, len(w0) AS n, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM base
), doc AS (
  SELECT d, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE
    list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w
  FROM spot
), word AS MATERIALIZED (
  SELECT d, n, unnest(range(n)) AS i, unnest(w) AS w FROM doc
), gram AS (
  SELECT d, n, i, hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g FROM word WINDOW o AS (PARTITION BY d ORDER BY i)
), lag_ AS (
  SELECT d, q FROM (SELECT x.d, y.i - x.i AS q FROM gram x JOIN gram y ON x.d = y.d AND x.g = y.g AND x.i < y.i AND 4 * (y.i - x.i) <= x.n)
  GROUP BY d, q HAVING count(*) >= greatest(6, 4 * q) - q - 4
), same AS (
  SELECT l.d, l.q, x.i, x.i - row_number() OVER (PARTITION BY l.d, l.q ORDER BY x.i) AS island
  FROM lag_ l JOIN word x ON x.d = l.d JOIN word y ON y.d = l.d AND y.i = x.i + l.q AND y.w = x.w
), stretch AS (
  SELECT d, min(i) AS s, count(*) + q AS len, q FROM same GROUP BY d, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
  SELECT * FROM stretch a WHERE NOT EXISTS (SELECT 1 FROM stretch b WHERE b.d = a.d AND b.q < a.q AND b.s <= a.s AND b.s + b.len >= a.s + a.len)
), listed AS (
  SELECT d, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    max({{'len': len, 's': -s, 'q': -q}}) AS top FROM run GROUP BY d
), gone AS (
  SELECT DISTINCT d, unnest(range(s + q, s + len)) AS i FROM run
), kept AS (
  SELECT d, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (d, i) GROUP BY d
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-top.s)::BIGINT AS start, top.len::BIGINT AS length, (-top.q)::BIGINT AS period,
  (1000 * top.len // -top.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (d) LEFT JOIN kept USING (d)
"""


@query
def op11_personal_data(spark, sf_dir):
    found = personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    tally = [F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *tally, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _personal_data_sql() -> str:
    patterns = pii.PATTERNS | {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": "[0-9]([ -]?[0-9])+",
    }
    proposed = " UNION ALL ".join(
        f"SELECT {i} AS k, d, '{kind}' AS kind, unnest(regexp_extract_all(t, '{patterns[kind]}')) AS f, "
        f"unnest(string_split_regex(t, '{patterns[kind]}')[:-2]) AS before, unnest(string_split_regex(t, '{patterns[kind]}')[2:]) AS after, "
        f"generate_subscripts(regexp_extract_all(t, '{patterns[kind]}'), 1) AS i FROM doc WHERE regexp_matches(t, '{patterns[kind]}')"
        for i, kind in enumerate(pii.KINDS)
    )
    words = " ".join(f"WHEN '{k}' THEN regexp_matches(ctx, '{pii.near(w)}')" for k, w in pii.WORDS.items())
    lengths = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pii.IBAN_LENGTHS.items()) + "}"
    luhn = lambda x: (
        f"list_sum(list_transform(string_split(lpad({x}, 20, '0'), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN c::INT ELSE 2 * c::INT - CASE WHEN c >= '5' THEN 9 ELSE 0 END END)) % 10 = 0")
    inside = pii.INSIDE
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents), proposed AS ({proposed}
), placed AS (
  SELECT *, sum(length(before) + length(f)) OVER (PARTITION BY d, k ORDER BY i) AS e, regexp_replace(f, '[^0-9]', '', 'g') AS digits,
    translate(right(before, {pii.BEFORE}) || ' # ' || left(after, {pii.AFTER}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ctx FROM proposed
), weighed AS (
  SELECT *, e - length(f) AS s, CASE WHEN CASE kind {words} END THEN {pii.FOR} ELSE 0 END
    + CASE WHEN regexp_matches(ctx, '{pii.near(pii.AGAINST_WORDS)}') THEN {pii.AGAINST} ELSE 0 END AS extra,
    CASE WHEN k = 2 THEN length(regexp_extract(f, '{inside}', 1)) END AS lead, CASE WHEN k = 2 THEN regexp_extract(f, '{inside}', 2) END AS inner_,
    CASE WHEN k = 4 THEN regexp_extract(f, '^([A-Z0-9]( ?[A-Z0-9]){{' || coalesce(({lengths})[f[:2]], 1) - 1 || '}})', 1) END AS own
  FROM placed
), iban AS (
  SELECT *, replace(own, ' ', '') AS c FROM weighed WHERE k = 4 AND own <> ''
), base AS (
  SELECT d, k, kind, s, e FROM weighed WHERE CASE k
    WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(f, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 16 AND 19 AND {luhn("left(digits, 20)")}
    WHEN 3 THEN starts_with(f, '+') AND length(digits) BETWEEN 8 AND 15 ELSE false END
), added AS (
  SELECT d, k, kind, s, e FROM weighed ANTI JOIN base USING (d, k, s) WHERE {pii.PRIOR["inner_card"] + pii.CHECKSUM} + extra >= {pii.ACCEPTED}
    AND k = 2 AND length(digits) BETWEEN 13 AND 15 AND {luhn("left(digits, 20)")}
  UNION ALL
  SELECT d, k, kind, s + lead, s + lead + length(inner_) FROM weighed ANTI JOIN base USING (d, k, s) WHERE {pii.PRIOR["inner_card"] + pii.CHECKSUM} + extra >= {pii.ACCEPTED}
    AND k = 2 AND length(digits) > 16 AND inner_ <> '' AND {luhn("regexp_replace(inner_, '[^0-9]', '', 'g')")}
  UNION ALL
  SELECT d, k, kind, s, e FROM weighed WHERE k = 3 AND NOT starts_with(f, '+') AND {pii.PRIOR["national"]} + extra >= {pii.ACCEPTED}
    AND NOT regexp_matches(before, '[0-9][ .-]?$') AND NOT regexp_matches(after, '^[ .-]?[0-9]')
  UNION ALL
  SELECT d, k, kind, s, s + length(own) FROM iban WHERE ({lengths})[f[:2]] = length(c) AND {pii.PRIOR["iban"] + pii.CHECKSUM} + extra >= {pii.ACCEPTED}
    AND NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(substr(f, length(own) + 1) || after, '^[A-Za-z0-9]')
    AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c[5:] || c[:4], ''), lambda x: ascii(x)::BIGINT)),
      lambda r, x: (CASE WHEN x >= 65 THEN r * 100 + x - 55 ELSE r * 10 + x - 48 END) % 97) = 1
), told AS (
  SELECT d, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM base GROUP BY d
), listed AS (
  SELECT d, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM (FROM base UNION ALL FROM added) GROUP BY d
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(told.spans, '')) AS base_sha256, coalesce(listed.spans, '') AS spans
FROM doc LEFT JOIN told USING (d) LEFT JOIN listed USING (d)
"""


SQL["op11_personal_data"] = _personal_data_sql()


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by conversation and turn; a null counts as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(fault == 4, F.lit("user")).otherwise(blank("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


@query
def op13_conversation_repair(spark, sf_dir):
    given = read(spark, sf_dir, "conversations")
    told = Repair(damaged(given)).conversations()
    ids = given.select("conv_id").distinct()
    zero = lambda c: F.coalesce(f"t.{c}", F.lit(0).cast("long")).alias(c)
    return ids.alias("i").join(told.alias("t"), F.col("i.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("t.cost").isNotNull(), "left").select(
        "i.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("t.audit", F.lit("")).alias("audit"),
        F.coalesce("t.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


SQL["op13_conversation_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS f
  FROM conversations, crc_table
), convs AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), hurt AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), numbered AS MATERIALIZED (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM hurt JOIN convs ON hurt.conv_id IS NOT DISTINCT FROM convs.conv_id
), row_ AS MATERIALIZED (
  SELECT c, turn, role, text, i, role[1] AS x, lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), facts AS (
  SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY c
), moves(fault, x, q, letter, cost, r) AS (
  SELECT f, x, q, letter, cost + CASE WHEN f = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END, r FROM
    (VALUES (''), ('blank'), ('duplicate'), ('truncated')) AS a(f), (VALUES ('s'), ('u'), ('a'), ('')) AS b(x), (VALUES
      ('0', 'K', 's', 0, 's'), ('0', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('a', 'K', 'u', 0, 'u'), ('u', 'K', 'a', 0, 'a'),
      ('0', 'R', '', 3, 'u'), ('s', 'R', '', 3, 'u'), ('a', 'R', '', 3, 'u'), ('u', 'R', '', 3, 'a'),
      ('0', 'D', '', 4, '0'), ('s', 'D', '', 4, 's'), ('u', 'D', '', 4, 'u'), ('a', 'D', '', 4, 'a')) AS m(q, letter, wants, cost, r)
  WHERE (wants = '' OR wants = x) AND (letter = 'D' OR f IN ('', 'truncated'))
), inserts(q, letters, cost, r) AS (
  VALUES ('0', '', 0, '0'), ('s', '', 0, 's'), ('u', '', 0, 'u'), ('a', '', 0, 'a'), ('0', 'I', 3, 'u'), ('s', 'I', 3, 'u'), ('a', 'I', 3, 'u'), ('u', 'I', 3, 'a'),
    ('0', 'II', 6, 'a'), ('s', 'II', 6, 'a'), ('a', 'II', 6, 'a'), ('u', 'II', 6, 'u')
), walk AS (
  SELECT c, 0::BIGINT AS i, {{'cost': s.cost, 'audit': s.letters}} AS best, s.r AS q FROM facts, inserts s WHERE s.q = '0'
  UNION ALL
  SELECT w.c, w.i + 1, min({{'cost': w.best.cost + m.cost + s.cost, 'audit': w.best.audit || m.letter || s.letters}}), s.r
  FROM walk w JOIN row_ t ON t.c = w.c AND t.i = w.i + 1
    JOIN moves m ON m.q = w.q AND m.fault = t.fault AND m.x = CASE WHEN t.x IN ('s', 'u', 'a') THEN t.x ELSE '' END JOIN inserts s ON s.q = m.r
  GROUP BY w.c, w.i, s.r
), chosen AS (
  SELECT c, min(best) AS best FROM walk JOIN facts USING (c) WHERE i = n AND q IN ('0', 'a') GROUP BY c
), letter AS (
  SELECT c, unnest(string_split(best.audit, '')) AS l, generate_subscripts(string_split(best.audit, ''), 1) AS k FROM chosen
), step AS (
  SELECT c, l, k, count(*) FILTER (l <> 'I') OVER o AS i, count(*) FILTER (l <> 'D') OVER o AS written FROM letter WINDOW o AS (PARTITION BY c ORDER BY k)
), line AS (
  SELECT s.c, s.k, s.l, s.written, CASE WHEN l <> 'I' THEN t.text ELSE '' END AS text, t.role,
    max(CASE WHEN l = 'K' AND t.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.c) AS has_s
  FROM step s LEFT JOIN row_ t ON t.c = s.c AND t.i = s.i WHERE s.l <> 'D'
), repaired AS (
  SELECT c, string_agg(CASE WHEN l = 'K' THEN role WHEN (written - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS t FROM line GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(repaired.t, '')) AS repaired_sha256
FROM convs LEFT JOIN facts USING (c) LEFT JOIN chosen USING (c) LEFT JOIN repaired USING (c)
"""
