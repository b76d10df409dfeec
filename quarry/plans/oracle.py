"""The registered queries as SQL text for an independent engine. Tables are views named like the files."""

from __future__ import annotations

from quarry.operators.layout import HEADER_BYTES
from quarry.operators.prng import INCREMENT, MULTIPLIER, SEED
from quarry.plans.queries import DIGITS
from quarry.plans.tables import MCCS
from quarry.schemas import AMBIGUOUS, DIM, MCC_RISK

N = range(DIM)


def _each(text: str, sep: str = ", ") -> str:
    """text once for each dimension, with # as its number."""
    return sep.join(text.replace("#", str(i)) for i in N)


def _quantized(x: str) -> str:
    s = f"(greatest(least({x}, CAST(1 AS FLOAT)), CAST(-1 AS FLOAT)) * CAST(10000 AS FLOAT))"
    return f"CAST(trunc(CASE WHEN {s} >= 0 THEN {s} + CAST(0.5 AS FLOAT) ELSE {s} - CAST(0.5 AS FLOAT) END) AS INTEGER)"


def _f32(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


_QS = ", ".join(f"{_quantized(f'v{i}')} AS q{i}" for i in N)
R = (
    "r0 AS (SELECT vec_id AS orig_id, CAST(label % 2 AS INTEGER) AS label, CAST(label AS INTEGER) AS cluster_id, "
    + ", ".join(f"CAST(coalesce(embedding[{i + 1}], 0) AS FLOAT) AS v{i}" for i in N)
    + f" FROM embeddings), r AS (SELECT *, {_QS} FROM r0)"
)
QUERY = "x0 AS (SELECT vec_id AS id, " + ", ".join(f"CAST(coalesce(embedding[{DIM - i}], 0) AS FLOAT) AS v{i}" for i in N) + f" FROM embeddings), x AS (SELECT *, {_QS} FROM x0)"
CENTROIDS = "c AS (SELECT cluster_id, " + _each("CAST(round(avg(CAST(v# AS DOUBLE)), 4) AS FLOAT) AS c#") + " FROM r GROUP BY cluster_id)"
BOXES = "b AS (SELECT cluster_id, " + _each("min(q#) AS lo#, max(q#) AS hi#") + " FROM r GROUP BY cluster_id)"
INT_DIST = _each("CAST(x.q# - r.q# AS BIGINT) * (x.q# - r.q#)", " + ")
FLOAT_DIST = lambda a, b: _each(f"({a}.v# - {b}.c#) * ({a}.v# - {b}.c#)", " + ")
BOUND = _each("CAST(greatest(b.lo# - x.q#, x.q# - b.hi#, 0) AS BIGINT) * greatest(b.lo# - x.q#, x.q# - b.hi#, 0)", " + ")
TWELVE = "k AS (SELECT CAST(range AS INTEGER) AS cluster_id FROM range(12)), n AS (SELECT k.cluster_id, count(r.orig_id) AS n FROM k LEFT JOIN r USING (cluster_id) GROUP BY k.cluster_id)"
EXACT = f"p AS (SELECT x.id, r.orig_id, r.label, {INT_DIST} AS dist FROM x, r WHERE x.id % 100 = 0), e AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, orig_id) AS rank, orig_id, dist, label FROM p QUALIFY rank <= 5)"
VOTE = "v AS (SELECT x.id, CAST(coalesce(sum(e.label), 0) AS INTEGER) AS fraud_count FROM x LEFT JOIN e USING (id) WHERE x.id % 100 = 0 GROUP BY x.id)"


def _probed(nprobe: int, name: str = "pr") -> str:
    return f"{name} AS (SELECT x.id, c.cluster_id, row_number() OVER (PARTITION BY x.id ORDER BY {FLOAT_DIST('x', 'c')}, c.cluster_id) AS probe FROM x, c QUALIFY probe <= {nprobe})"


def _near(probes: str = "pr", name: str = "near") -> str:
    return f"{name} AS (SELECT x.id, r.orig_id, r.label, {INT_DIST} AS dist FROM {probes} JOIN x USING (id) JOIN r ON r.cluster_id = {probes}.cluster_id QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY dist, r.orig_id) <= 5)"


def _votes(near: str = "near", name: str = "fast") -> str:
    return f"{name} AS (SELECT x.id, CAST(coalesce(sum({near}.label), 0) AS INTEGER) AS fraud_count FROM x LEFT JOIN {near} ON {near}.id = x.id GROUP BY x.id)"


WORST = "w AS (SELECT id, CASE WHEN count(*) >= 5 THEN max(dist) END AS worst FROM near GROUP BY id)"
MORE = (
    f"m AS (SELECT x.id, b.cluster_id, {BOUND} AS bound, w.worst FROM fast JOIN x USING (id) LEFT JOIN w USING (id), b "
    f"WHERE fast.fraud_count IN {AMBIGUOUS} AND (w.worst IS NULL OR {BOUND} <= w.worst) AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.id = x.id AND pr.cluster_id = b.cluster_id))"
)
REFINED = (
    f"al AS (SELECT id, orig_id, label, dist FROM near UNION ALL SELECT m.id, r.orig_id, r.label, {INT_DIST} FROM m JOIN x USING (id) JOIN r ON r.cluster_id = m.cluster_id), "
    "t5 AS (SELECT id, label FROM al QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, orig_id) <= 5), "
    "s5 AS (SELECT id, CAST(sum(label) AS INTEGER) AS again FROM t5 GROUP BY id), "
    f"f AS (SELECT fast.id, fast.fraud_count AS fast_count, fast.fraud_count IN {AMBIGUOUS} AS refined, CASE WHEN fast.fraud_count IN {AMBIGUOUS} THEN coalesce(s5.again, 0) ELSE fast.fraud_count END AS fraud_count FROM fast LEFT JOIN s5 USING (id))"
)

_TIME = "'%Y-%m-%dT%H:%M:%SZ'"
EVENTS = (
    f"e0 AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS INTEGER) AS k, strftime(ts, {_TIME}) AS made FROM events), "
    "e AS (SELECT event_id AS request_key, event_type, value, k, made, 'MERC-' || k AS merchant_id, "
    "row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) > 1 AS known, "
    "CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id) / count(*) OVER (PARTITION BY user_id) / 100 AS FLOAT) AS average, "
    "count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n_day, "
    "lag(made) OVER o AS last_at, lag(value) OVER o AS last_value, "
    + "[" + ", ".join(f"'{m}'" for m in MCCS) + f"][k % {len(MCCS)} + 1] AS mcc "
    "FROM e0 WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id))"
)
_RISK = "CASE mcc " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MCC_RISK.items()) + " ELSE 0.5 END"


def _field(text: str, at: int, size: int) -> str:
    return f"TRY_CAST(substr({text}, {at}, {size}) AS INTEGER)"


def _valid(text: str) -> str:
    f = lambda at: _field(text, at, 2)
    return f"coalesce(regexp_matches({text}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}.', 's') AND {f(6)} BETWEEN 1 AND 12 AND {f(9)} BETWEEN 1 AND 31 AND {f(12)} <= 23 AND {f(15)} <= 59 AND {f(18)} <= 59, false)"


def _date(text: str) -> str:
    return f"(make_date({_field(text, 1, 4)}, {_field(text, 6, 2)}, 1) + ({_field(text, 9, 2)} - 1))"


def _seconds(text: str) -> str:
    return f"(date_diff('day', DATE '1970-01-01', {_date(text)}) * 86400 + {_field(text, 12, 2)} * 3600 + {_field(text, 15, 2)} * 60 + {_field(text, 18, 2)})"


def _weekday(text: str) -> str:
    return f"CAST(isodow({_date(text)}) - 1 AS INTEGER)"


_MINUTES = f"(abs({_seconds('made')} - {_seconds('last_at')}) // 60)"


def _clamp(x: str) -> str:
    return f"greatest(least({x}, CAST(1 AS FLOAT)), CAST(0 AS FLOAT))"


def _share(x: str, most: float) -> str:
    return f"({_f32(x)} * {_f32(f'CAST(1 AS DOUBLE) / {most}')})"


_FEATURES = [
    _clamp(_share("value * 20", 10000)),
    _clamp(_share("k % 13", 12)),
    f"CASE WHEN average > 0 THEN {_clamp(_f32('CAST(CAST(value * 20 AS FLOAT) AS DOUBLE) / average') + ' * ' + _f32('CAST(1 AS DOUBLE) / 10'))} ELSE {_f32('1')} END",
    _share(_field("made", 12, 2), 23),
    _share(_weekday("made"), 6),
    f"CASE WHEN last_at IS NULL THEN {_f32('-1')} ELSE {_clamp(_share(_MINUTES, 1440))} END",
    f"CASE WHEN last_at IS NULL THEN {_f32('-1')} ELSE {_clamp(_share('last_value', 1000))} END",
    _clamp(_share("value * 3", 1000)),
    _clamp(_share("n_day", 20)),
    _f32("CAST(event_type IN ('click', 'view') AS INTEGER)"),
    _f32("CAST(event_type = 'purchase' AS INTEGER)"),
    _f32("CAST(NOT known AS INTEGER)"),
    _f32(_RISK),
    _clamp(_share("k * 25", 10000)),
]
FEATURES = EVENTS + ", g AS (SELECT request_key, " + ", ".join(f"{x} AS v{i}" for i, x in enumerate(_FEATURES)) + f" FROM e), x AS (SELECT *, request_key AS id, {_QS} FROM g)"

_put = lambda at, text: f"substr(t, 1, {at - 1}) || '{text}' || substr(t, {at + len(text)})"
_KINDS = ["t", "substr(t, 1, 19)", _put(11, " "), _put(6, "13"), _put(6, "00"), _put(9, "32"), _put(9, "00"), _put(12, "24"), _put(15, "60"), _put(18, "60"), _put(20, "+03:00"), _put(20, "x"), _put(6, "02-31"), _put(1, "x"), "''", "'   '", "NULL"]
DAMAGED = f"d AS (SELECT event_id, [{', '.join(_KINDS)}][event_id % {len(_KINDS)} + 1] AS text FROM (SELECT event_id, strftime(ts, {_TIME}) AS t FROM events))"
_RANDOM = f"g AS (SELECT CAST(0 AS BIGINT) AS draw, CAST({SEED} AS UHUGEINT) AS state UNION ALL SELECT draw + 1, (state * CAST({MULTIPLIER} AS UHUGEINT) + CAST({INCREMENT} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) FROM g WHERE draw < @)"
_ASSIGNED = f"a AS (SELECT r.*, c.cluster_id AS nearest FROM r, c QUALIFY row_number() OVER (PARTITION BY r.orig_id ORDER BY {FLOAT_DIST('r', 'c')}, c.cluster_id) = 1)"
_INDEXED = "n AS (SELECT cluster_id, count(*) AS n FROM r GROUP BY cluster_id)"
_IVF = lambda nprobe: (R, QUERY, CENTROIDS, _probed(nprobe), _near(), _votes())

#: Generator states of all draws of a training with @ clusters, the sampled rows, and the picks one by one.
_SAMPLE = "(SELECT least(count(*), 65536) FROM r)"
_DRAWN = lambda i: f"(SELECT state FROM g WHERE draw = {_SAMPLE} + {i})"
_VS = _each("v#")


def _picks(k: int) -> list[str]:
    """Tables p0..: the initial centroids, each next one where the running sum of least distances passes a drawn share of it."""
    out = [
        _RANDOM.replace("@", f"({_SAMPLE} + {k})"),
        f"s0 AS MATERIALIZED (SELECT draw - 1 AS place, {_VS}, CAST(1e30 AS FLOAT) AS low FROM g JOIN r ON r.orig_id = CAST((state // 8589934592) % (SELECT count(*) FROM r) AS BIGINT) WHERE draw BETWEEN 1 AND {_SAMPLE})",
        f"p0 AS MATERIALIZED (SELECT * FROM s0 WHERE place = CAST(({_DRAWN(1)} // 8589934592) % {_SAMPLE} AS BIGINT))",
    ]
    distance = _each("(s.v# - p.v#) * (s.v# - p.v#)", " + ")
    for i in range(1, k):
        out += [
            f"s{i} AS MATERIALIZED (SELECT s.place, {_each('s.v#')}, least(s.low, {distance}) AS low FROM s{i - 1} s, p{i - 1} p)",
            f"u{i} AS MATERIALIZED (SELECT place, sum(CAST(low AS DOUBLE)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM s{i})",
            f"p{i} AS MATERIALIZED (SELECT * FROM s{i} WHERE place = (SELECT coalesce(min(place), {_SAMPLE} - 1) FROM u{i} WHERE upto >= CAST({_DRAWN(i + 1)} // 2048 AS DOUBLE) / 9007199254740992 * (SELECT max(upto) FROM u{i})))",
        ]
    return out + ["t0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS cluster_id, {_each('v# AS c#')} FROM p{i}" for i in range(k)) + ")"]


def _trained(k: int, rounds: int) -> list[str]:
    """Tables a1.. (assignments) and t1.. (centroids) of each round; once fewer than one row in a thousand moved, nothing changes."""
    out = [R, *_picks(k)]
    for i in range(1, rounds + 1):
        near = f"SELECT r.orig_id, c.cluster_id AS nearest FROM r, t{i - 1} c QUALIFY row_number() OVER (PARTITION BY r.orig_id ORDER BY {FLOAT_DIST('r', 'c')}, c.cluster_id) = 1"
        if i == 1:
            out += [f"a1 AS MATERIALIZED ({near})", "d1 AS (SELECT false AS done)"]
        else:
            out += [
                f"a{i} AS MATERIALIZED (SELECT b.orig_id, CASE WHEN (SELECT done FROM d{i - 1}) THEN b.nearest ELSE x.nearest END AS nearest FROM a{i - 1} b JOIN ({near}) x USING (orig_id))",
                f"d{i} AS MATERIALIZED (SELECT (SELECT done FROM d{i - 1}) OR count_if(x.nearest <> b.nearest) * 1000 < count(*) AS done FROM a{i} x JOIN a{i - 1} b USING (orig_id))",
            ]
        means = _each("CAST(avg(CAST(v# AS DOUBLE)) AS FLOAT) AS m#")
        out.append(f"t{i} AS MATERIALIZED (SELECT c.cluster_id, {_each('coalesce(m#, c#) AS c#')} FROM t{i - 1} c LEFT JOIN (SELECT nearest, {means} FROM a{i} JOIN r USING (orig_id) GROUP BY nearest) m ON m.nearest = c.cluster_id)")
    return out


_BUILT = "z AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, CAST(sum((n + 7) // 8) AS BIGINT) AS blocks FROM (SELECT c.cluster_id, count(a.orig_id) AS n FROM t0 c LEFT JOIN a5 a ON a.nearest = c.cluster_id GROUP BY c.cluster_id))"
_FACTS = {"n": "n", "k": "k", "blocks": "blocks", "rows": "n", "bytes": f"{HEADER_BYTES} + k * {DIM * 8} + (k + 1) * 8 + blocks * {DIM * 16} + n * 5"} | dict.fromkeys(("unknown_clusters", "wrong_counts", "wrong_offsets", "wrong_blocks", "wrong_block_offsets", "unsound_rows"), "0")

ORACLE_SQL = {
    "label_encode": "SELECT vec_id, CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END AS encoded FROM embeddings",
    "vector_pad14": "SELECT vec_id, " + ", ".join(f"CASE WHEN vec_id % 20 > {i} THEN {_quantized(f'embedding[{i + 1}]')} ELSE 0 END AS q{i}" for i in N) + " FROM embeddings",
    "quantize_vectors": _with(R) + "SELECT orig_id, " + _each("q#") + " FROM r",
    "quantize_bounds": f"SELECT vec_id, {_quantized('(embedding[1] * CAST(10 AS FLOAT))')} AS wide, {_quantized('CAST(CAST(vec_id % 400 - 200 AS DOUBLE) / 20000 AS FLOAT)')} AS half FROM embeddings",
    "iso_parse_valid": _with(DAMAGED) + f"SELECT event_id, {_valid('text')} AS valid FROM d",
    "civil_days": "WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '-31T10:00:00Z' AS t FROM orders) "
    f"SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', {_date('t')}) AS INTEGER) AS days, {_weekday('t')} AS weekday FROM o",
    "weekday_mon0": "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders",
    "minutes_between": _with(EVENTS) + f"SELECT request_key, {_MINUTES} AS minutes FROM e WHERE last_at IS NOT NULL",
    "clamp_norm": f"SELECT event_id, round(CAST({_clamp(_share('value * 100 - 500', 10000))} AS DOUBLE), {DIGITS}) AS share FROM events",
    "mcc_risk_lookup": _with(EVENTS) + f"SELECT request_key, mcc, round(CAST({_RISK} AS DOUBLE), 2) AS risk FROM e",
    "mcc_risk_join": _with(EVENTS) + f"SELECT mcc, count(*) AS requests, round(CAST(max({_RISK}) AS DOUBLE), 2) AS risk FROM e GROUP BY mcc",
    "known_merchant_flag": _with(EVENTS) + "SELECT request_key, known FROM e",
    "int_l2_pairs": _with(R, "f AS (SELECT min(orig_id) AS id FROM r GROUP BY cluster_id)", "x AS (SELECT r.* FROM r JOIN f ON r.orig_id = f.id)") + f"SELECT r.orig_id, x.orig_id AS seed_id, {INT_DIST} AS dist FROM r, x",
    "float_l2_centroids": _with(R, CENTROIDS) + f"SELECT r.orig_id, c.cluster_id AS centroid, round(CAST({FLOAT_DIST('r', 'c')} AS DOUBLE), {DIGITS}) AS dist FROM r, c",
    "bbox_lower_bound": _with(R, QUERY, BOXES) + f"SELECT x.id, b.cluster_id, {BOUND} AS bound FROM x, b",
    "request_validate_status": _with(DAMAGED) + f"SELECT event_id AS request_key, CASE WHEN {_valid('text')} THEN 200 ELSE 400 END AS status FROM d",
    "request_decode": _with(EVENTS) + "SELECT request_key, CASE WHEN request_key % 8 IN (0, 7) THEN 200 WHEN request_key % 8 = 5 THEN 413 ELSE 400 END AS status, "
    "CASE WHEN request_key % 8 IN (0, 7) THEN CAST(k % 13 AS BIGINT) END AS installments FROM e",
    "feature_vector": _with(FEATURES) + "SELECT request_key, " + _each(f"round(CAST(v# AS DOUBLE), {DIGITS}) AS v#") + " FROM x",
    "feature_vector_quantized": _with(FEATURES) + "SELECT request_key, " + _each("q#") + " FROM x",
    "cluster_counts": _with(R, TWELVE) + "SELECT cluster_id, n FROM n",
    "cluster_offsets": _with(R, TWELVE) + "SELECT cluster_id, n, CAST(coalesce(sum(n) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_offset FROM n",
    "block_offsets": _with(R, TWELVE) + "SELECT cluster_id, (n + 7) // 8 AS blocks, CAST(coalesce(sum((n + 7) // 8) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM n",
    "block_lane_position": _with(R, "s AS (SELECT orig_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY orig_id) - 1 AS position FROM r)") + "SELECT orig_id, cluster_id, position, position // 8 AS block, CAST(position % 8 AS INTEGER) AS lane FROM s",
    "cluster_bbox": _with(R, TWELVE, BOXES) + "SELECT n.cluster_id, " + _each("coalesce(lo#, 0) AS lo#, coalesce(hi#, 0) AS hi#") + " FROM n LEFT JOIN b USING (cluster_id)",
    "cluster_centroids": _with(R) + "SELECT cluster_id, count(*) AS n, " + _each(f"round(CAST(CAST(avg(CAST(v# AS DOUBLE)) AS FLOAT) AS DOUBLE), {DIGITS}) AS c#") + " FROM r GROUP BY cluster_id",
    "index_size_estimate": _with(R, _INDEXED, "s AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS k, CAST(sum((n + 7) // 8) AS BIGINT) AS blocks FROM n)")
    + f"SELECT n, k, blocks, {HEADER_BYTES} + k * {DIM * 8} + (k + 1) * 8 + blocks * {DIM * 16} + n * 5 AS bytes FROM s",
    "layout_validate": "SELECT CAST(0 AS BIGINT) AS unknown_clusters, CAST(0 AS BIGINT) AS wrong_counts, CAST(0 AS BIGINT) AS wrong_offsets, CAST(0 AS BIGINT) AS wrong_blocks, CAST(0 AS BIGINT) AS wrong_block_offsets, CAST(0 AS BIGINT) AS unsound_rows, count(*) AS rows FROM embeddings",
    "nearest_centroid": _with(R, CENTROIDS, _ASSIGNED) + "SELECT orig_id, nearest AS cluster_id FROM a",
    "top_nprobe_clusters": _with(R, QUERY, CENTROIDS, _probed(3)) + "SELECT id, CAST(probe AS INTEGER) AS probe, cluster_id FROM pr",
    "knn_exact_top5": _with(R, QUERY, EXACT) + "SELECT id, CAST(rank AS INTEGER) AS rank, orig_id, dist, label FROM e",
    "knn_vote": _with(R, QUERY, EXACT, VOTE) + "SELECT id, fraud_count FROM v",
    "fraud_assessment": _with(R, QUERY, EXACT, VOTE) + "SELECT id, fraud_count, fraud_count < 3 AS approved, CAST(fraud_count AS DOUBLE) / 5 AS fraud_score FROM v",
    "score_response_json": _with(R, QUERY, EXACT, VOTE) + """SELECT id, '{"approved":' || CASE WHEN fraud_count < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || printf('%.1f', fraud_count / 5.0) || '}' AS body FROM v""",
    "ivf_fast_vote_nprobe1": _with(*_IVF(1)) + "SELECT id, fraud_count FROM fast",
    "ivf_fast_vote_nprobe8": _with(*_IVF(8)) + "SELECT id, fraud_count FROM fast",
    "ivf_refined_vote": _with(*_IVF(2), BOXES, WORST, MORE, REFINED) + "SELECT id, fast_count, refined, fraud_count FROM f",
    "bbox_prune_candidates": _with(*_IVF(2), BOXES, WORST, MORE) + "SELECT id, cluster_id, bound, worst FROM m",
    "ivf_visited_anti": _with(R, QUERY, CENTROIDS, _probed(99)) + "SELECT id, cluster_id FROM pr WHERE probe > 3",
    "ivf_recall_vs_exact": _with(R, QUERY, CENTROIDS, _probed(3), _near(), EXACT) + "SELECT count(*) AS neighbours, count(near.orig_id) AS found FROM e LEFT JOIN near ON near.id = e.id AND near.orig_id = e.orig_id",
    "confusion_matrix": _with(*_IVF(2), BOXES, WORST, MORE, REFINED, EXACT, VOTE, "z AS (SELECT f.fraud_count >= 3 AS rejected, v.fraud_count >= 3 AS fraud FROM f JOIN v USING (id))")
    + "SELECT CAST(count_if(rejected AND fraud) AS BIGINT) AS tp, CAST(count_if(NOT rejected AND NOT fraud) AS BIGINT) AS tn, CAST(count_if(rejected AND NOT fraud) AS BIGINT) AS fp, CAST(count_if(NOT rejected AND fraud) AS BIGINT) AS fn, round(count_if(rejected <> fraud) / count(*), 6) AS failure_rate FROM z",
    "score_requests": _with(FEATURES, R, CENTROIDS, _probed(8), _near(), _votes(), BOXES, WORST, MORE, REFINED)
    + """SELECT id AS request_key, 200 AS status, fraud_count, fraud_count < 3 AS approved, '{"approved":' || CASE WHEN fraud_count < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || printf('%.1f', fraud_count / 5.0) || '}' AS body FROM f""",
    "lcg_sequence": _with(_RANDOM.replace("@", "1000")) + "SELECT draw, CAST(state AS VARCHAR) AS state FROM g WHERE draw > 0",
    "kmeans_sample_ids": _with(_RANDOM.replace("@", "(SELECT least(count(*), 65536) FROM embeddings)")) + "SELECT draw - 1 AS place, CAST((state // 8589934592) % (SELECT count(*) FROM embeddings) AS BIGINT) AS orig_id FROM g WHERE draw > 0",
    "kmeans_lloyd_1": _with(R, CENTROIDS, _ASSIGNED) + "SELECT nearest AS cluster_id, count(*) AS n, " + _each("round(CAST(CAST(avg(CAST(v# AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) AS c#") + " FROM a GROUP BY nearest",
    "kmeans_change_count": _with(R, CENTROIDS, _ASSIGNED) + "SELECT count(*) AS n, CAST(count_if(nearest <> cluster_id) AS BIGINT) AS changed FROM a",
    "kmeanspp_init": _with(R, *_picks(16)) + "SELECT * FROM t0",
    "kmeans_train": _with(*_trained(16, 10)) + "SELECT nearest AS cluster_id, count(*) AS n FROM a10 GROUP BY nearest",
    "index_build": _with(*_trained(16, 5), _BUILT) + " UNION ALL ".join(f"SELECT '{k}' AS fact, CAST({v} AS BIGINT) AS value FROM z" for k, v in _FACTS.items()),
    "index_roundtrip": _with(R) + "SELECT cluster_id, orig_id, label, " + _each("q#") + " FROM r",
}
#: A stream gives what a batch gives.
ORACLE_SQL["stream_score"] = ORACLE_SQL["score_requests"]
