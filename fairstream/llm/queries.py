"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairstream.llm import html, langid, lattice, licenses, manifest, mixing, pieces, repeats, sharding, simhash, tokencount, topk, urls


# fixed values: the rules of the filter and what makes a title junk (two such signs in a row)
URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)
JUNK_TITLE = r"<title>[^<]*(!!|##|\$\$|%%|\*\*)"


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB: several are in memory at once, in the JVM and in each Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs at which some page has a junk title."""
    pages = _table(spark, sf_dir, "pages")
    junk = pages.filter(F.col("html").rlike(JUNK_TITLE))
    listed = junk.select(urls.canonical(F.col("url")).alias("key"))
    return urls.judge(pages, URL_RULES, listed)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encoded(_table(spark, sf_dir, "documents"), tokenizer_file())


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokencount.counted(_table(spark, sf_dir, "documents"), tokenizer_file())


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _crc32(value: Column) -> Column:
    return F.crc32(value.cast("string"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proves itself; every seventh (by checksum of its id) with a changed ``n_chars``."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(_crc32(F.col("doc_id")) % 7 == 0, manifest.leaf_digest(*changed))
    leaves = docs.select("doc_id", "lang", manifest.leaf_digest(*fields).alias("leaf"), tampered.alias("tampered"))
    made = manifest.manifest(leaves, "lang", "doc_id", "leaf")
    found = manifest.proofs(made, made.leaves.select("doc_id", "grp", "at", "tampered"))
    groups = made.groups.select("grp", "subroot")
    root = F.lit(made.root).cast("string")
    folded_root = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    joined = found.join(F.broadcast(groups) if groups.count() <= manifest.BROADCAST_ROWS else groups, "grp")
    return joined.select(
        "doc_id",
        "leaf",
        "subroot",
        root.alias("root"),
        manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        folded_root.alias("folded_root"),
        (folded_root == root).alias("verified"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    crc = F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32")
    found = sharding.sharded(docs.select("doc_id", "text", crc), keep=["doc_id", "text_crc32"])
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of every tenth document (by checksum of its id) go on in a period from some word on."""
    for batch in batches:
        texts = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
            if h % 10 == 0 and (words := (text.as_py() or b"").split()):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                tail = words[a : a + p]
                texts.append(b" ".join(words[:a] + (tail * ((n - a) // p + 1))[: n - a]))
            else:
                texts.append(text.as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    found = repeats.periodic_runs(docs.mapInArrow(_planted, "doc_id bigint, text binary"))
    best = F.array_sort(
        "runs",
        lambda a, b: F.when(a["length"] != b["length"], F.sign(b["length"] - a["length"]))
        .when(a["start"] != b["start"], F.sign(a["start"] - b["start"]))
        .otherwise(F.sign(a["period"] - b["period"]))
        .cast("int"),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    shown = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best_run = F.get(best, F.lit(0))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best_run.alias("best"),
        F.sha2(shown, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_simhash": op4_simhash,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_count": op8_token_count,
    "op9_html_text": op9_html_text,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM totals),
weighed AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, [0.5::DOUBLE, 0, -0.5][place % 3 + 1] AS slope,
         2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM ranked),
filling AS (SELECT *,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM weighed),
judged AS (SELECT *, cap * weights_left <= (wanted - before) * weight AS is_full FROM filling),
targets AS (SELECT source, source_size, slope, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
         ELSE (wanted - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * weight / sum(weight) FILTER (NOT is_full) OVER () END AS target
  FROM judged),
sources AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM targets),
keys AS (SELECT source, key, sum(size) AS key_size FROM sized GROUP BY source, key),
running AS (SELECT *, sum(key_size) OVER (PARTITION BY source ORDER BY key) - key_size / 2 AS middle,
         sum(key_size) OVER (PARTITION BY source ORDER BY key) AS upto,
         substr(key, 1, 3) AS prefix FROM keys),
prefixes AS (SELECT source, prefix, sum(key_size) AS prefix_size, max(upto) - sum(key_size) AS before FROM running GROUP BY source, prefix),
cuts AS (SELECT r.source, max(key) AS last_key FROM running r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
  WHERE middle <= target - epochs * s.source_size AND target - epochs * s.source_size > 0 GROUP BY r.source),
placed AS (SELECT d.doc_id, d.size, s.source_size, target, slope,
         epochs + CASE WHEN key <= last_key THEN 1 ELSE 0 END AS copies,
         least((CAST(p.before AS DOUBLE) + CAST(CAST('0x' || substr(key, 4, 9) AS BIGINT) AS DOUBLE) / 68719476736.0::DOUBLE * p.prefix_size) / target, 1) AS y
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
  JOIN prefixes p ON d.source IS NOT DISTINCT FROM p.source AND substr(key, 1, 3) = p.prefix
  LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 AND target > 0 THEN 2 * y / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y)) END AS position
FROM placed
"""

URL_SQL = r"""
WITH parts AS (SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''),
                   '(?:^|&)(?:utm_[^&=]*|ref)(?:=[^&]*)?', '', 'g'), '^&', '') AS rest
  FROM pages),
keyed AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '')
    || regexp_replace(path, '/+$', '') || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END END AS key FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches(html, '<title>[^<]*(!!|##|\$\$|%%|\*\*)')),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
    ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path, r.rule_host || r.rule_path AS rule,
  coalesce(r.verdict, CASE WHEN key IN (SELECT key FROM listed WHERE key IS NOT NULL) THEN 'block' END, 'allow') AS verdict
FROM keyed LEFT JOIN LATERAL (SELECT * FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host))
  AND starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC LIMIT 1) r ON true
"""

TOP_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5
"""

# the checksum of a decimal id byte by byte; nodes of one level become those of the next by window
MERKLE_SQL = r"""
WITH RECURSIVE
steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS step),
fields AS (SELECT doc_id, lang, n_chars, CAST(doc_id AS VARCHAR) AS id_text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
digests AS (SELECT doc_id, lang,
    sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(list_reduce(list_transform(range(1, len(id_text) + 1), lambda i: CAST(ascii(substr(id_text, i, 1)) AS BIGINT)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0
      THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered
  FROM fields, steps),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM digests),
nodes AS (SELECT grp, 0 AS level, place, leaf AS digest FROM leaves UNION ALL
  SELECT grp, level + 1, place // 2, sha256(digest || coalesce(next_digest, '')) FROM
    (SELECT *, lead(digest) OVER (PARTITION BY grp ORDER BY place) AS next_digest, count(*) OVER (PARTITION BY grp) AS n FROM nodes)
  WHERE n > 1 AND place % 2 = 0),
subroots AS (SELECT grp, max(level) AS height, arg_max(digest, level) AS subroot FROM nodes GROUP BY grp),
above AS (SELECT 0 AS level, grp AS place, subroot AS digest FROM subroots UNION ALL
  SELECT level + 1, place // 2, sha256(digest || coalesce(next_digest, '')) FROM
    (SELECT *, lead(digest) OVER (ORDER BY place) AS next_digest, count(*) OVER () AS n FROM above)
  WHERE n > 1 AND place % 2 = 0),
top AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM above),
ways AS (
  SELECT l.grp, l.place, k.level, (l.place >> k.level) % 2 = 1 AS is_right, n.digest AS other
  FROM leaves l JOIN subroots s USING (grp) CROSS JOIN LATERAL (SELECT unnest(range(s.height)) AS level) k
  LEFT JOIN nodes n ON n.grp = l.grp AND n.level = k.level AND n.place = xor(l.place >> k.level, 1)
  UNION ALL
  SELECT l.grp, l.place, 1000 + k.level, (l.grp >> k.level) % 2 = 1, n.digest
  FROM leaves l CROSS JOIN top t CROSS JOIN LATERAL (SELECT unnest(range(t.height)) AS level) k
  LEFT JOIN above n ON n.level = k.level AND n.place = xor(l.grp >> k.level, 1)),
paths AS (SELECT grp, place, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256,
    list(CASE WHEN is_right THEN 'L' ELSE 'R' END || coalesce(other, '') ORDER BY level) AS steps FROM ways GROUP BY grp, place),
checked AS (SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(coalesce(steps, []), lambda own, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || own ELSE own || x[2:] END),
      coalesce(tampered, leaf)) AS folded_root
  FROM leaves JOIN subroots USING (grp) CROSS JOIN top LEFT JOIN paths USING (grp, place))
SELECT *, folded_root = root AS verified FROM checked
"""

ORACLES = {
    "op11_merkle_manifest": MERKLE_SQL,
    "op1_license_scan": licenses.scan_sql(),
    "op3_mix_sources": MIX_SQL,
    "op6_url_filter": URL_SQL,
    "op10_exact_top_k": TOP_SQL,
}
