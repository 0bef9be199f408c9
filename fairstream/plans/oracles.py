"""The registered queries as DuckDB SQL, by other means than the operators use.

Farthest-first traversals are recursive queries over all points, the online sketch is a plain
window over all arrivals, log records come from windows over whole files.
"""

from __future__ import annotations

from fairstream.functions.hashing import DRAWS, PRIME, hash_pairs
from fairstream.operators import runs
from fairstream.operators.frequency import Frequency
from fairstream.plans import queries as q

POINTS = """
  SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS x0, floor(o_totalprice) AS x1,
         CAST(month(o_orderdate) AS DOUBLE) AS x2,
         CASE WHEN o_orderstatus = 'O' THEN 'A' ELSE o_orderstatus END AS label
  FROM orders"""

EMBEDDINGS = (
    "SELECT vec_id AS id, CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS label, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(64))
    + " FROM embeddings"
)


def double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


# clustering


def _draw(seed: int | None) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || id), 1, 15) AS BIGINT)" if seed is not None else "0"


def walk(name: str, source: str, dims: int, ka: int, kb: int, seed: int | None = None) -> str:
    """Tables ``{name}_walk`` and ``{name}(part, rank, id, x.., label)`` of a recursive WITH.

    ``source`` names a table with part, id, x0.., label.
    """
    xs = [f"x{i}" for i in range(dims)]
    axes = ", ".join(xs)
    picked = ", ".join(f"max(CASE WHEN rn = 1 THEN {x} END) OVER w AS p{x}" for x in xs)
    gap = " + ".join(f"({x} - p{x}) * ({x} - p{x})" for x in xs)
    steps = max(1, ka + kb)
    return f"""
{name}_walk AS (
  SELECT 0 AS step, part, id, {axes}, label, {_draw(seed)} AS draw,
         CAST('Infinity' AS DOUBLE) AS md, CAST(NULL AS INT) AS rank,
         {ka} AS left_a, {kb} AS left_b
  FROM {source}
  UNION ALL
  SELECT step + 1, part, id, {axes}, label, draw, least(md, {gap}),
         CASE WHEN rn = 1 AND rank IS NULL THEN step ELSE rank END,
         left_a - grew * CAST(plabel = 'A' AS INT), left_b - grew * CAST(plabel <> 'A' AS INT)
  FROM (
    SELECT *, {picked}, max(CASE WHEN rn = 1 THEN label END) OVER w AS plabel,
           max(CASE WHEN rn = 1 AND rank IS NULL THEN 1 ELSE 0 END) OVER w AS grew
    FROM (
      SELECT *, row_number() OVER (PARTITION BY part ORDER BY rank IS NOT NULL,
        CASE WHEN step = 0 THEN draw ELSE 0 END,
        step = 0 OR (left_a > 0 AND left_b > 0) OR (label = 'A') = (left_a > 0) DESC,
        md DESC, id) AS rn
      FROM {name}_walk WHERE step < {steps})
    WINDOW w AS (PARTITION BY part))
),
{name} AS (SELECT part, rank, id, {axes}, label FROM {name}_walk WHERE step = {steps} AND rank IS NOT NULL)"""


def exact(ka: int, kb: int, seed: int | None = None, points: str = POINTS, dims: int = 3) -> str:
    return (
        f"WITH RECURSIVE points AS ({points}), whole AS (SELECT 0 AS part, * FROM points), "
        + walk("centers", "whole", dims, ka, kb, seed)
    )


def two_rounds(ka: int, kb: int, parts: int, seed: int | None = None) -> str:
    return (
        f"WITH RECURSIVE points AS ({POINTS}), parted AS (SELECT id % {parts} AS part, * FROM points), "
        + walk("coreset", "parted", 3, ka, kb, seed)
        + ", merged AS (SELECT * REPLACE (0 AS part) FROM coreset), "
        + walk("centers", "merged", 3, ka, kb, seed)
    )


def near(dims: int = 3) -> str:
    gap = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(dims))
    return (
        f", near AS (SELECT p.id, any_value(p.label) AS label, min({gap}) AS md "
        "FROM points p CROSS JOIN centers c GROUP BY p.id)"
    )


CENTERS = " SELECT rank, id, x0, x1, x2, label FROM centers"
RADIUS = " SELECT round(sqrt(max(md)), 6) AS objective FROM near"

# documents

LINES = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS line, unnest(parts) AS value
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
words AS (SELECT doc_id, line, unnest(string_split(value, ' ')) AS word FROM lines)"""

WORD_COUNT = f"WITH {LINES} SELECT word, count(*) AS n FROM words GROUP BY word"

# stream items

ITEMS = "items AS (SELECT event_id AS seq, CAST(floor(value) AS BIGINT) - 20 AS item FROM events)"


def _hash(a: int, b: int, width: int) -> str:
    return f"((({a} * item + {b}) % {PRIME} + {PRIME}) % {PRIME}) % {width}"


def _toss(seed: int, key: str = "seq") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 15) AS BIGINT)"


def stream(run: Frequency, length: str, suffix: str = "", key: str = "seq") -> str:
    """Tables of one run over ``arrivals``; ``run.n`` is not used, ``length`` is SQL for it."""
    s = suffix
    pairs = " UNION ALL ".join(
        f"SELECT item, seq, {r} AS r, {_hash(a, b, run.width)} AS c FROM arrivals"
        for r, (a, b) in enumerate(run.pairs)
    )
    slack = f"({double(run.phi)} - {double(run.epsilon)})"
    return f"""
len{s} AS (SELECT {length} AS n),
firsts{s} AS (
  SELECT item, min(seq) AS first_seq FROM arrivals, len{s}
  WHERE {_toss(run.seed, key)} <= CAST(floor(least({double(run.rate)} / n, 1) * {double(DRAWS)}) AS BIGINT) GROUP BY item),
sticky{s} AS (
  SELECT item, count(*) AS n FROM arrivals JOIN firsts{s} USING (item) WHERE seq >= first_seq GROUP BY item),
sticky_freq{s} AS (SELECT sticky{s}.* FROM sticky{s}, len{s} WHERE sticky{s}.n >= {slack} * len{s}.n),
hit{s} AS ({pairs}),
grown{s} AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY seq) AS cell FROM hit{s}),
estimate{s} AS (SELECT seq, any_value(item) AS item, min(cell) AS est FROM grown{s} GROUP BY seq),
countmin{s} AS (
  SELECT item, count(*) AS n FROM estimate{s} GROUP BY item
  HAVING max(est) >= {double(run.phi)} * (SELECT n FROM len{s}))"""


TRUTH = "truth AS (SELECT item, count(*) AS n FROM arrivals GROUP BY item)"
WHOLE = f"WITH {ITEMS}, arrivals AS (SELECT * FROM items), {TRUTH}, "
PREFIX_LENGTH = "(SELECT count(*) * 4 // 5 FROM items)"
PREFIX = f"WITH {ITEMS}, arrivals AS (SELECT * FROM items WHERE seq < {PREFIX_LENGTH}), {TRUTH}, "
EXACT_FREQ = f"(SELECT truth.* FROM truth, len WHERE truth.n >= {double(q.PHI)} * len.n)"

REPORT = f"""
SELECT 'exact' AS algorithm, item, n AS true_freq FROM {EXACT_FREQ}
UNION ALL SELECT 'sticky', item, truth.n FROM sticky_freq JOIN truth USING (item)
UNION ALL SELECT 'countmin', item, n FROM countmin"""


def quality() -> str:
    """One row per experiment."""
    tables, rows = [], []

    def add(name: str, run: Frequency, algorithm: str, param: float, number: int) -> None:
        tables.append(stream(run, "(SELECT count(*) FROM arrivals)", name))
        found = f"sticky_freq{name}" if algorithm == "sticky" else f"countmin{name}"
        size = f"(SELECT count(*) FROM sticky{name})" if algorithm == "sticky" else "count(*)"
        high = f"truth.n >= {double(q.PHI)} * len{name}.n"
        mid = f"truth.n >= len{name}.n * ({double(q.PHI)} - {double(run.epsilon)})"
        rows.append(f"""
SELECT '{algorithm}' AS algorithm, {double(param)} AS param, {number} AS run,
       count(*) FILTER ({high}) AS frequent, count(*) FILTER (NOT ({high}) AND {mid}) AS almost,
       count(*) FILTER (NOT ({high}) AND NOT ({mid})) AS rare, {size} AS size
FROM {found} JOIN truth USING (item), len{name}""")

    for number, seed in enumerate(q.SEEDS):
        for i, epsilon in enumerate(q.EPSILONS):
            run = Frequency(1, q.PHI, epsilon, seed=seed)
            add(f"_s{number}{i}", run, "sticky", epsilon, number)
        for i, width in enumerate(q.WIDTHS):
            run = Frequency(1, q.PHI, q.CLASS_EPSILON, width=width, seed=seed)
            add(f"_c{number}{i}", run, "countmin", width, number)
    return WHOLE + ", ".join(tables) + ", experiments AS (" + " UNION ALL ".join(rows) + ")"


# distinct items by batch

TAKEN = f"""WITH {ITEMS},
batches AS (SELECT seq // 750 AS batch, item FROM items),
sizes AS (SELECT batch, count(*) AS size FROM batches GROUP BY batch),
ahead AS (SELECT *, coalesce(sum(size) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM sizes),
kept AS (SELECT * FROM ahead WHERE seen < {PREFIX_LENGTH}),
taken AS (SELECT batch, item FROM batches JOIN kept USING (batch))"""

# logs

# A record is a block of lines up to a runtime line, found in a state. What a block does to the four states
# (2 with a data set, 1 with an objective) is a list; lists are composed by doubling.
LOG = f"""WITH RECURSIVE log AS (
  SELECT CASE WHEN o_custkey % 4 = 3 THEN 'other.txt' ELSE 'combined_logs_v' || (o_custkey % 4) || '.txt' END AS file,
         o_orderkey AS k, o_orderkey % 7 = 3 AS crashed, o_totalprice,
         CASE WHEN o_orderstatus = 'P' THEN 'plain_' ELSE 'Artificial' END
           || CASE WHEN o_orderkey % 17 = 6 THEN '' ELSE o_orderpriority END || '.csv' AS path
  FROM orders),
lines AS (
  SELECT file, k * 8 AS line, '=== FILE: run_' || (2 << CAST(k % 4 AS INT)) || '.log ===' AS value FROM log WHERE k % 3 = 0
  UNION ALL SELECT file, k * 8 + 1, 'File path = ' || path || ', KA = ' || (k % 2 + 7) || ', KB = 2, L = 16' FROM log WHERE k % 13 <> 4
  UNION ALL SELECT file, k * 8 + 3, 'Objective function = ' || (floor(o_totalprice) / 8) FROM log WHERE NOT crashed AND k % 11 <> 5
  UNION ALL SELECT file, k * 8 + 4, 'Running time of MRFairFFT = ' || CAST(floor(o_totalprice) AS BIGINT) || ' ms' FROM log WHERE NOT crashed),
seen AS (
  SELECT file, line, value,
         nullif(regexp_extract(value, '{runs.HEADER}', 1), '') AS workers,
         CASE WHEN regexp_matches(value, '{runs.CONFIG}') THEN regexp_extract(value, '{runs.CONFIG}', 1) END AS path,
         nullif(regexp_extract(value, '{runs.CONFIG}', 2), '') AS ka,
         nullif(regexp_extract(value, '{runs.CONFIG}', 3), '') AS kb,
         nullif(regexp_extract(value, '{runs.CONFIG}', 4), '') AS l,
         nullif(regexp_extract(value, '{runs.OBJECTIVE}', 1), '') AS objective,
         nullif(regexp_extract(value, '{runs.RUNTIME}', 1), '') AS runtime
  FROM lines),
named AS (
  SELECT *, CASE WHEN regexp_matches(path, '{runs.DATASET}') THEN regexp_extract(path, '{runs.DATASET}', 1) ELSE path END AS dataset FROM seen),
carried AS (
  SELECT *, last_value(workers IGNORE NULLS) OVER w AS w, last_value(dataset IGNORE NULLS) OVER w AS p,
         last_value(ka IGNORE NULLS) OVER w AS a, last_value(kb IGNORE NULLS) OVER w AS b,
         last_value(l IGNORE NULLS) OVER w AS ll, last_value(objective IGNORE NULLS) OVER w AS o,
         count(runtime) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run
  FROM named WINDOW w AS (PARTITION BY file ORDER BY line)),
blocks AS (
  SELECT file, run, max(w) FILTER (runtime IS NOT NULL) IS NOT NULL AS with_workers, count(objective) > 0 AS with_objective,
         arg_max(dataset <> '', line) FILTER (dataset IS NOT NULL) AS with_dataset
  FROM carried GROUP BY file, run HAVING count(runtime) > 0),
found AS (
  SELECT *, list_transform(range(4), lambda s: CASE WHEN coalesce(with_dataset, s >= 2) THEN 2 ELSE 0 END
                                             + CASE WHEN with_objective OR s % 2 = 1 THEN 1 ELSE 0 END) AS reached FROM blocks),
effects AS (
  SELECT file, run, with_workers, reached,
         list_transform(reached, lambda s: CASE WHEN s = 3 AND with_workers THEN 0 ELSE s END) AS effect FROM found),
composed AS (
  SELECT 1 AS step, file, run, effect FROM effects UNION ALL
  SELECT 2 * p.step, p.file, p.run, CASE WHEN e.effect IS NULL THEN p.effect ELSE list_transform(e.effect, lambda s: p.effect[s + 1]) END
  FROM composed p LEFT JOIN composed e ON e.file = p.file AND e.run = p.run - p.step
  WHERE p.step <= (SELECT max(run) FROM effects)),
before AS (SELECT file, run + 1 AS run, effect[1] AS state FROM composed WHERE step > (SELECT max(run) FROM effects)),
finished AS (SELECT file, run FROM effects LEFT JOIN before USING (file, run) WHERE with_workers AND reached[coalesce(state, 0) + 1] = 3),
records AS (
  SELECT coalesce(nullif(regexp_extract(file, '{runs.VERSION}', 1), ''), 'unknown') AS version, p AS dataset,
         CAST(w AS INT) AS workers, CAST(ll AS INT) AS l, CAST(runtime AS BIGINT) AS runtime_ms,
         a AS ka, b AS kb, CAST(o AS DOUBLE) AS objective
  FROM carried JOIN finished USING (file, run) WHERE runtime IS NOT NULL)"""


def all_oracles() -> dict[str, str]:
    run = Frequency(1, q.PHI, q.EPSILON, q.DELTA, q.DEPTH, q.WIDTH, q.SEED)
    whole = WHOLE + stream(run, "(SELECT count(*) FROM arrivals)")
    part = PREFIX + stream(run, PREFIX_LENGTH)
    (a, b), (c, d) = hash_pairs(2, q.SEED)
    embedding = exact(5, 4, points=EMBEDDINGS, dims=64)
    class_low = f"len.n * ({double(q.PHI)} - {double(q.CLASS_EPSILON)})"
    coreset = two_rounds(q.KA, q.KB, q.PARTS) + (
        " SELECT CAST(part AS INT) AS part, rank, id, x0, x1, x2, label FROM coreset"
    )
    means = ", ".join(f"avg({c}) AS {c}" for c in ("frequent", "almost", "rare", "size"))
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("frequent", "almost", "rare", "size"))
    printed = ", ".join(f"printf('%.2f', {c}) AS {c}" for c in ("frequent", "almost", "rare", "size"))
    averages = f"{quality()}, means AS (SELECT algorithm, param, {means} FROM experiments GROUP BY ALL)"
    counts = "count(*) AS n, count(*) FILTER (label = 'A') AS na, count(*) FILTER (label <> 'A') AS nb"
    return {
        "point_scan": f"WITH points AS ({POINTS}) SELECT row_number() OVER (ORDER BY id) - 1 AS id, x0, x1, x2, label FROM points",
        "point_parse": "SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS x0, CAST(o_orderkey AS DOUBLE) AS x1, "
        "CAST(month(o_orderdate) AS DOUBLE) AS x2, CAST(year(o_orderdate) AS DOUBLE) AS x3, "
        "floor(o_totalprice) AS x4, o_orderstatus AS label FROM orders",
        "label_counts": f"WITH points AS ({POINTS}) SELECT {counts} FROM points",
        "part_sizes": f"SELECT CAST(o_orderkey % {q.PARTS} AS INT) AS part, count(*) AS n FROM orders GROUP BY 1",
        "squared_distance": f"WITH points AS ({POINTS}) SELECT id, (x0 - c_custkey) * (x0 - c_custkey) + "
        "(x1 - floor(c_acctbal)) * (x1 - floor(c_acctbal)) + (x2 - 6) * (x2 - 6) AS squared "
        "FROM points JOIN customer ON c_custkey = x0",
        "fair_fft": exact(q.KA, q.KB) + CENTERS,
        "fair_fft_seeded": exact(q.KA, q.KB, q.SEED) + CENTERS,
        "fair_fft_lazy": exact(q.KA, q.KB) + CENTERS,
        "fair_fft_one_budget": exact(0, 5) + CENTERS,
        "fair_fft_embeddings": embedding + " SELECT rank, id, label FROM centers",
        "fair_fft_embeddings_radius": embedding + near(64) + RADIUS,
        "local_centers": coreset,
        "local_centers_in_step": coreset,
        "mr_fair_fft": two_rounds(q.KA, q.KB, q.PARTS) + CENTERS,
        "mr_fair_fft_placed": two_rounds(q.KA, q.KB, q.PARTS) + CENTERS,
        "mr_fair_fft_seeded": two_rounds(8, 2, 16, q.SEED) + CENTERS,
        "nearest_center": exact(q.KA, q.KB) + near() + " SELECT id, label, round(sqrt(md), 6) AS distance FROM near",
        "objective": two_rounds(q.KA, q.KB, q.PARTS) + near() + RADIUS,
        "clustering_report": two_rounds(q.KA, q.KB, q.PARTS)
        + near()
        + f" SELECT {counts}, (SELECT round(sqrt(max(md)), 6) FROM near) AS objective FROM points",
        "doc_count": f"WITH {LINES} SELECT count(*) AS docs FROM lines",
        "docs_file": f"WITH {LINES} SELECT (SELECT count(*) FROM lines) AS docs, count(*) AS words, "
        "round(avg(length(word)), 6) AS mean_length FROM (SELECT DISTINCT word FROM words)",
        "tokens": f"WITH {LINES} SELECT doc_id, line, count(*) AS words, count(*) FILTER (word = '') AS empty_words, "
        "CAST(sum(length(word)) AS BIGINT) AS letters FROM words GROUP BY doc_id, line",
        "doc_word_count": f"WITH {LINES} SELECT doc_id, line, word, count(*) AS n FROM words GROUP BY ALL",
        "word_count": WORD_COUNT,
        "word_count_salted_shuffle": WORD_COUNT,
        "word_count_salted_map": WORD_COUNT,
        "word_count_partitioned": WORD_COUNT,
        "distinct_words": f"WITH {LINES} SELECT count(DISTINCT word) AS words FROM words",
        "mean_word_length": f"WITH {LINES} SELECT round(avg(length(word)), 6) AS mean_length "
        "FROM (SELECT DISTINCT word FROM words)",
        "item_parse": f"WITH {ITEMS} SELECT item, count(*) AS n FROM items GROUP BY item",
        "stream_prefix": PREFIX.rstrip(", ") + " SELECT seq, item FROM arrivals",
        "stream_prefix_end": f"WITH {ITEMS}, len AS (SELECT {PREFIX_LENGTH} AS n) "
        "SELECT (SELECT min(seq) FROM items) AS first_seq, (SELECT seq FROM (SELECT seq, row_number() OVER "
        "(ORDER BY seq) AS rn FROM items), len WHERE rn = n) AS seq_cut, (SELECT item FROM (SELECT item, "
        "row_number() OVER (ORDER BY item) AS rn FROM items), len WHERE rn = n) AS item_cut",
        "hash_values": f"WITH {ITEMS} SELECT seq, item, {_toss(q.SEED)} / {double(DRAWS)} AS u, "
        f"CAST({_hash(a, b, q.WIDTH)} AS INT) AS h0, CAST({_hash(c, d, q.WIDTH)} AS INT) AS h1 FROM items",
        "histogram": f"WITH {ITEMS} SELECT item, count(*) AS n FROM items GROUP BY item",
        "quality_class": f"{whole} SELECT item, truth.n, CASE WHEN truth.n >= {double(q.PHI)} * len.n THEN 'frequent' "
        f"WHEN truth.n >= {class_low} THEN 'almost' ELSE 'rare' END AS kind FROM truth, len",
        "true_frequent": f"{whole} SELECT * FROM {EXACT_FREQ}",
        "sticky_sample": f"{whole} SELECT * FROM sticky",
        "sticky_frequent": f"{whole} SELECT * FROM sticky_freq",
        "sticky_sample_size": f"{whole} SELECT count(*) AS size FROM sticky",
        "countmin_matrix": f"{whole} SELECT r, CAST(c AS INT) AS c, count(*) AS n FROM hit GROUP BY ALL",
        "countmin_crossings": f"{whole} SELECT r, CAST(c AS INT) AS c, min(seq) AS seq FROM grown, len "
        f"WHERE cell >= {double(q.PHI)} * len.n GROUP BY ALL",
        "countmin_frequent": f"{whole} SELECT * FROM countmin",
        "countmin_total": f"{whole} SELECT count(*) AS total FROM countmin",
        "frequent_report": f"{whole} {REPORT}",
        "quality_counts": f"{quality()} SELECT * FROM experiments",
        "quality_averages": f"{averages} SELECT algorithm, param, {rounded} FROM means",
        "summary": f"{averages} SELECT algorithm, param, {printed} FROM means",
        "whole_batches": f"{TAKEN} SELECT batch, item FROM taken",
        "batch_sizes": f"{TAKEN} SELECT batch, size FROM sizes",
        "distinct_by_batch": f"{TAKEN} SELECT DISTINCT batch, item FROM batches",
        "distinct_items": f"{TAKEN} SELECT DISTINCT item FROM batches",
        "distinct_report": f"{TAKEN} SELECT count(*) AS items, count(DISTINCT item) AS distinct_items, "
        "max(item) AS largest FROM batches",
        "stream_frequent": f"{part} {REPORT}",
        "stream_replay": f"{part} {REPORT}",
        "stream_compacted": f"{part} {REPORT}",
        "stream_text_frequent": PREFIX + stream(run, PREFIX_LENGTH, key="'0:' || seq") + REPORT,
        "stream_native_histogram": f"WITH {ITEMS} SELECT item, count(*) AS n FROM items GROUP BY item",
        "stream_native_distinct": f"WITH {ITEMS} SELECT DISTINCT item FROM items",
        "stream_sticky_sample": f"{part} SELECT * FROM sticky",
        "stream_keyed_sample": f"{part} SELECT * FROM sticky",
        "stream_batch_sizes": PREFIX.rstrip(", ")
        + ", cuts AS (SELECT unnest(range(4)) AS batch_id, (SELECT count(*) FROM items) AS n) "
        "SELECT batch_id, count(*) AS size FROM cuts JOIN arrivals ON seq >= n * batch_id // 4 "
        "AND seq < n * (batch_id + 1) // 4 GROUP BY batch_id",
        "stream_distinct": f"WITH {ITEMS}, cut AS (SELECT unnest(range(4)) AS k, (SELECT count(*) FROM items) AS n), "
        "whole AS (SELECT max(n * (k + 1) // 4) AS upto FROM cut WHERE n * k // 4 < n * 3 // 5) "
        "SELECT count(*) AS items, count(DISTINCT item) AS distinct_items, max(item) AS largest "
        "FROM items, whole WHERE seq < upto",
        "run_logs_file": f"{LOG} SELECT * FROM records WHERE version <> 'unknown'",
        "run_records": f"{LOG} SELECT * FROM records",
        "objective_statistics": f"{LOG} SELECT version, dataset, ka, kb, l, round(avg(objective), 4) AS mean_objective, "
        "round(coalesce(stddev_samp(objective), 0), 4) AS std_objective FROM records GROUP BY ALL",
        "runtime_mean": f"{LOG} SELECT version, dataset, workers, l, ka, kb, round(avg(runtime_ms), 4) AS runtime_ms "
        "FROM records GROUP BY ALL",
        "runtime_min": f"{LOG} SELECT version, dataset, workers, l, ka, kb, CAST(min(runtime_ms) AS DOUBLE) AS runtime_ms "
        "FROM records GROUP BY ALL",
    }
