"""DuckDB SQL that gives the same rows as the queries of the same name.

The statements are put together from shared steps; each step is one common
table expression, and a chain of them is one statement.
"""

from __future__ import annotations

from ..operators.isoforest import EULER, LAST_SHIFT, MIX_ROUNDS, STEP, TURN
from ..schema import (
    CATEGORICAL,
    CLUSTERS,
    FEATURES,
    MODES,
    NUMERIC,
    RAW_COLUMNS,
    SAMPLE_PER_TREE,
    SEED,
    STORED_NUMERIC,
)
from .packets import PACKETS_SELECT, SHORT_END, TRAIN_END, TRAIN_START

TREES = MODES["low"]["trees"]
ROUNDS = 4
# Rounds after which the compared k-means fit ends at the latest.
FIT_ROUNDS = 12
LEVELS = 8


def _with(steps: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in steps)
    return f"WITH {body}\n{final}"


def _r(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {alias or expr}"


PACKETS = ("packets", PACKETS_SELECT.format(events="events"))

TYPED = (
    "typed",
    "SELECT frame_number AS row_id, try_cast(timestamp AS TIMESTAMP) AS ts, "
    + ", ".join(
        "CASE WHEN tcp_flags IS NULL OR tcp_flags = '' THEN 'NA' ELSE tcp_flags END AS tcp_flags"
        if c == "tcp_flags"
        else f"coalesce({c}, '__NA__') AS {c}"
        for c in CATEGORICAL
    )
    + ", "
    + ", ".join(f"coalesce(try_cast({c} AS DOUBLE), 0) AS {c}" for c in STORED_NUMERIC)
    + ", split_part(file_name, '_', 2) AS day FROM packets",
)


def _timed(name: str, where: str = "true") -> tuple[str, str]:
    return (
        name,
        "SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts NULLS LAST, "
        f"row_id) AS DOUBLE) / 1e6, 0) AS iat FROM typed WHERE {where}",
    )


def _dates(start: str, end: str) -> str:
    return f"day BETWEEN '{start}' AND '{end}'"


ALL = [PACKETS, TYPED, _timed("scored")]
SPLIT = [*ALL, _timed("trained", _dates(TRAIN_START, TRAIN_END))]


def _vocab(source: str) -> tuple[str, str]:
    parts = [
        f"SELECT '{c}' AS col, value, CAST(row_number() OVER (ORDER BY value) - 1 AS DOUBLE) AS code "
        f"FROM (SELECT DISTINCT {c} AS value FROM {source})"
        for c in CATEGORICAL
    ]
    return "vocab", " UNION ALL ".join(parts)


def _scaler(source: str) -> tuple[str, str]:
    parts = [
        f"SELECT '{c}' AS col, avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
        f"ELSE stddev_pop({c}) END AS scale FROM {source}"
        for c in NUMERIC
    ]
    return "scaler", " UNION ALL ".join(parts)


def _coded(name: str, source: str) -> tuple[str, str]:
    joins = " ".join(
        f"LEFT JOIN vocab v{i} ON v{i}.col = '{c}' AND v{i}.value = s.{c}"
        for i, c in enumerate(CATEGORICAL)
    )
    codes = ", ".join(f"coalesce(v{i}.code, -1.0) AS {c}" for i, c in enumerate(CATEGORICAL))
    return name, f"SELECT s.row_id, {codes} FROM {source} s {joins}"


WIDE_SCALER = (
    "wide_scaler",
    "SELECT "
    + ", ".join(
        f"max(CASE WHEN col = '{c}' THEN mean END) AS mean_{c}, "
        f"max(CASE WHEN col = '{c}' THEN scale END) AS scale_{c}"
        for c in NUMERIC
    )
    + " FROM scaler",
)


def _matrix(name: str, source: str) -> list[tuple[str, str]]:
    scaled = ", ".join(f"(s.{c} - w.mean_{c}) / w.scale_{c} AS {c}" for c in NUMERIC)
    codes = ", ".join(f"c.{c}" for c in CATEGORICAL)
    return [
        _coded(f"{name}_codes", source),
        (
            name,
            f"SELECT s.row_id, {codes}, {scaled} FROM {source} s "
            f"JOIN {name}_codes c USING (row_id), wide_scaler w",
        ),
    ]


WHOLE_MATRIX = [*ALL, _vocab("scored"), _scaler("scored"), WIDE_SCALER, *_matrix("known", "scored")]
SPLIT_MATRIX = [
    *SPLIT,
    _vocab("trained"),
    _scaler("trained"),
    WIDE_SCALER,
    *_matrix("known", "trained"),
    *_matrix("input", "scored"),
]

SQUARED = " + ".join(f"(m.{c} - c.{c}) * (m.{c} - c.{c})" for c in FEATURES)


def _nearest(rows: str, centres: str) -> str:
    return (
        f"SELECT row_id, cluster, d2 FROM (SELECT m.row_id, c.cluster, {SQUARED} AS d2, "
        f"row_number() OVER (PARTITION BY m.row_id ORDER BY {SQUARED}, c.cluster) AS place "
        f"FROM {rows} m, {centres} c) WHERE place = 1"
    )


def _lloyd(rows: str, rounds: int) -> list[tuple[str, str]]:
    columns = ", ".join(FEATURES)
    steps = [
        (
            "centres0",
            "SELECT CAST(row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) - 1 "
            f"AS INTEGER) AS cluster, {columns} FROM {rows} QUALIFY cluster < {CLUSTERS}",
        )
    ]
    for i in range(rounds):
        means = ", ".join(f"avg(m.{c}) AS {c}" for c in FEATURES)
        kept = ", ".join(f"coalesce(a.{c}, c.{c}) AS {c}" for c in FEATURES)
        steps += [
            (f"nearest{i}", _nearest(rows, f"centres{i}")),
            (
                f"means{i}",
                f"SELECT n.cluster, {means} FROM nearest{i} n JOIN {rows} m USING (row_id) GROUP BY 1",
            ),
            (
                f"centres{i + 1}",
                f"SELECT c.cluster, {kept} FROM centres{i} c LEFT JOIN means{i} a USING (cluster)",
            ),
        ]
    return steps


def _mixed(expr: str) -> str:
    """The hash behind a starting draw, as an unsigned 64-bit integer."""
    x = f"(({expr})::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (
            f"((xor({x}, {x} >> {shift})::UHUGEINT * {factor}::UHUGEINT) "
            "% 18446744073709551616::UHUGEINT)::UBIGINT"
        )
    return x


def _restarts(rows: str, restarts: int, rounds: int) -> list[tuple[str, str]]:
    """k-means++ draws of all restarts, then rounds in which a restart at rest stays."""
    columns = ", ".join(f"m.{c}" for c in FEATURES)
    variance = " + ".join(f"var_pop({c})" for c in FEATURES)
    steps = [
        ("tries", f"SELECT CAST(range AS INTEGER) AS restart FROM range({restarts})"),
        ("still", f"SELECT 1e-4 * ({variance}) / {len(FEATURES)} AS limit_ FROM {rows}"),
    ]
    for t in range(CLUSTERS):
        salt = f"((({SEED} + restart) * 1000 + {t})::UHUGEINT * 11400714819323198485::UHUGEINT)"
        first = _mixed(f"row_id::UHUGEINT + {salt} % 18446744073709551616::UHUGEINT")
        steps.append((f"hash{t}", f"SELECT row_id, restart, {first} AS h FROM {rows}, tries"))
        uniform = "((xor(h, h >> 31) >> 11)::DOUBLE + 1.0) / 9007199254740992.0"
        if t:
            steps.append(
                (
                    f"weight{t}",
                    f"SELECT m.row_id, c.restart, min({SQUARED}) AS w "
                    f"FROM {rows} m, chosen{t - 1} c GROUP BY 1, 2",
                )
            )
            race = f"SELECT row_id, restart, -ln({uniform}) / nullif(w, 0) AS t FROM hash{t} JOIN weight{t} USING (row_id, restart)"
        else:
            race = f"SELECT row_id, restart, -ln({uniform}) AS t FROM hash{t}"
        won = (
            f"SELECT restart, {t} AS cluster, {columns} FROM (SELECT restart, "
            f"arg_min(row_id, t) AS row_id FROM ({race}) GROUP BY 1) JOIN {rows} m USING (row_id)"
        )
        before = f"SELECT * FROM chosen{t - 1} UNION ALL " if t else ""
        steps.append((f"chosen{t}", before + won))
    steps.append(("try0", f"SELECT *, false AS done FROM chosen{CLUSTERS - 1}"))
    near = (
        f"SELECT row_id, restart, cluster, d2 FROM (SELECT m.row_id, c.restart, c.cluster, "
        f"{SQUARED} AS d2, row_number() OVER (PARTITION BY m.row_id, c.restart "
        f"ORDER BY {SQUARED}, c.cluster) AS place FROM {rows} m, {{}} c) WHERE place = 1"
    )
    means = ", ".join(f"avg(m.{c}) AS {c}" for c in FEATURES)
    moved = ", ".join(
        f"CASE WHEN c.done THEN c.{c} ELSE coalesce(a.{c}, c.{c}) END AS {c}" for c in FEATURES
    )
    gap = " + ".join(f"(n.{c} - c.{c}) * (n.{c} - c.{c})" for c in FEATURES)
    kept = ", ".join(f"n.{c}" for c in FEATURES)
    for i in range(rounds):
        steps += [
            (f"near{i}", near.format(f"try{i}")),
            (
                f"mean{i}",
                f"SELECT n.restart, n.cluster, {means} FROM near{i} n "
                f"JOIN {rows} m USING (row_id) GROUP BY 1, 2",
            ),
            (
                f"moved{i}",
                f"SELECT c.restart, c.cluster, {moved} FROM try{i} c "
                f"LEFT JOIN mean{i} a USING (restart, cluster)",
            ),
            (
                f"shift{i}",
                f"SELECT restart, sum({gap}) AS shift FROM moved{i} n "
                f"JOIN try{i} c USING (restart, cluster) GROUP BY 1",
            ),
            (
                f"try{i + 1}",
                f"SELECT restart, n.cluster, {kept}, shift <= limit_ AS done FROM moved{i} n "
                f"JOIN shift{i} USING (restart), still",
            ),
        ]
    steps.append(
        (
            "costs",
            f"SELECT restart, round(sum(d2), 3) AS cost FROM ({near.format(f'try{rounds}')}) GROUP BY 1",
        )
    )
    return steps


def _uniform(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _priority(row_id: str, tree: str) -> str:
    """The 64-bit hash of a row for a tree; products are taken with 128 bits."""
    word = 1 << 64

    def cut(value: str) -> str:
        return f"CAST(({value}) % {word}::UHUGEINT AS UBIGINT)"

    offset = f"({tree} + 1)::UHUGEINT * {STEP}::UHUGEINT + {SEED * TURN % word}::UHUGEINT"
    x = cut(f"{row_id}::UHUGEINT + {offset}")
    for shift, factor in MIX_ROUNDS:
        x = cut(f"list_transform([{x}], lambda v: xor(v, v >> {shift}))[1]::UHUGEINT * {factor}::UHUGEINT")
    return f"list_transform([{x}], lambda v: xor(v, v >> {LAST_SHIFT}))[1]"


def _forest(rows: str) -> list[tuple[str, str]]:
    """Samples, then one step per level: ends of each feature, pick and cut, move rows."""
    place = "row_number() OVER (PARTITION BY tree ORDER BY"
    long = " UNION ALL ".join(
        f"SELECT s.tree, s.row_id, {i} AS f, m.{c} AS x FROM sample s JOIN {rows} m USING (row_id)"
        for i, c in enumerate(FEATURES)
    )
    steps = [
        ("trees", f"SELECT CAST(range AS INTEGER) AS tree FROM range({TREES})"),
        (
            "hashes",
            f"SELECT tree, row_id, {_priority('row_id', 'tree')} AS hash FROM {rows}, trees",
        ),
        (
            "sample",
            f"SELECT tree, row_id FROM (SELECT tree, row_id, {place} hash, row_id) AS place FROM hashes) "
            f"WHERE place <= {SAMPLE_PER_TREE}",
        ),
        ("long", long),
        ("size", "SELECT max(c) AS sample, ceil(log2(greatest(max(c), 2))) AS depth FROM "
                 "(SELECT count(*) AS c FROM sample GROUP BY tree)"),
        ("at0", "SELECT tree, row_id, CAST(1 AS INTEGER) AS node FROM sample"),
    ]
    for level in range(LEVELS):
        steps += [
            (
                f"split{level}",
                "SELECT tree, node, f, CASE WHEN cut >= high THEN low ELSE cut END AS cut FROM ("
                f"SELECT *, low + {_uniform(f"concat('{SEED}|cut|', tree, '|', node)")} * (high - low) "
                f"AS cut, row_number() OVER (PARTITION BY tree, node ORDER BY "
                f"md5(concat('{SEED}|', tree, '|', node, '|', f))) AS place FROM ("
                f"SELECT tree, node, f, min(x) AS low, max(x) AS high FROM at{level} "
                f"JOIN long USING (tree, row_id) GROUP BY 1, 2, 3 HAVING max(x) > min(x))) , size "
                f"WHERE place = 1 AND {level} < depth",
            ),
            (
                f"at{level + 1}",
                "SELECT a.tree, a.row_id, CASE WHEN s.node IS NULL THEN a.node "
                "WHEN l.x <= s.cut THEN 2 * a.node ELSE 2 * a.node + 1 END AS node "
                f"FROM at{level} a LEFT JOIN split{level} s USING (tree, node) "
                "LEFT JOIN long l ON l.tree = a.tree AND l.row_id = a.row_id AND l.f = s.f",
            ),
        ]
    splits = " UNION ALL ".join(
        f"SELECT tree, node, f, cut, {i} AS depth FROM split{i}" for i in range(LEVELS)
    )
    # Rows of a split node: those that ended at it or below it.
    inner = " UNION ALL ".join(
        f"SELECT s.tree, s.node, count(*) AS n_samples FROM split{i} s "
        f"JOIN at{i} a USING (tree, node) GROUP BY 1, 2"
        for i in range(LEVELS)
    )
    steps += [
        ("splits", splits),
        ("inner_sizes", inner),
        (
            "leaves",
            "SELECT tree, node, CAST(floor(log2(node)) AS INTEGER) AS depth, count(*) AS n_samples "
            f"FROM at{LEVELS} GROUP BY 1, 2",
        ),
    ]
    return steps


def _mean_depth(n: str) -> str:
    return (
        f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 "
        f"ELSE 2.0 * (ln({n} - 1.0) + {EULER}) - 2.0 * ({n} - 1.0) / {n} END)"
    )


def _iso_scores(rows: str) -> list[tuple[str, str]]:
    """Every row walks every tree; then leaf depth plus the depth left in the leaf."""
    steps = [
        (
            "input_long",
            " UNION ALL ".join(
                f"SELECT row_id, {i} AS f, {c} AS x FROM {rows}" for i, c in enumerate(FEATURES)
            ),
        ),
        ("walk0", f"SELECT tree, row_id, CAST(1 AS INTEGER) AS node FROM trees, {rows}"),
    ]
    for level in range(LEVELS):
        steps.append(
            (
                f"walk{level + 1}",
                "SELECT w.tree, w.row_id, CASE WHEN s.node IS NULL THEN w.node "
                "WHEN l.x <= s.cut THEN 2 * w.node ELSE 2 * w.node + 1 END AS node "
                f"FROM walk{level} w LEFT JOIN split{level} s USING (tree, node) "
                "LEFT JOIN input_long l ON l.row_id = w.row_id AND l.f = s.f",
            )
        )
    steps += [
        (
            "paths",
            f"SELECT w.row_id, avg(l.depth + {_mean_depth('l.n_samples')}) AS path "
            f"FROM walk{LEVELS} w JOIN leaves l USING (tree, node) GROUP BY 1",
        ),
        (
            "iso",
            f"SELECT row_id, 0.5 - pow(2.0, -path / {_mean_depth('sample')}) AS iso_score "
            "FROM paths, size",
        ),
    ]
    return steps


FOREST_STEPS = _forest("known")
ISO_STEPS = [*SPLIT_MATRIX, *FOREST_STEPS, *_iso_scores("input")]
LLOYD_STEPS = _lloyd("known", ROUNDS)
ASSIGN_STEPS = [
    *SPLIT_MATRIX,
    *LLOYD_STEPS,
    ("assigned", _nearest("input", f"centres{ROUNDS}")),
]
SUMMARY_STEPS = [
    *ISO_STEPS,
    *LLOYD_STEPS,
    ("assigned", _nearest("input", f"centres{ROUNDS}")),
    (
        "summary",
        f"SELECT count(*) AS rows, {_r('avg(iso_score)', 'iso_score_mean')}, "
        f"{_r('min(iso_score)', 'iso_score_min')}, "
        f"{_r('avg(CASE WHEN iso_score < 0 THEN 1.0 ELSE 0.0 END)', 'anomaly_ratio_iso')}, "
        f"{_r('avg(sqrt(d2))', 'kmeans_distance_mean')}, "
        f"{_r('max(sqrt(d2))', 'kmeans_distance_max')} FROM iso JOIN assigned USING (row_id)",
    ),
]

NAMES = [PACKETS, ("names", "SELECT DISTINCT file_name FROM packets")]
DATE_FIELD = "split_part(regexp_replace(file_name, '\\.[^.]*$', ''), '_', 2)"
MINUTES = r"try_cast(nullif(regexp_extract(file_name, '\(([0-9.]+)_minutes\)', 1), '') AS DOUBLE)"


def _bucket(s: str) -> str:
    return (
        f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} < 300 THEN 'SHORT' WHEN {s} < 3600 THEN 'MEDIUM' "
        f"WHEN {s} < 86400 THEN 'LONG' ELSE 'VERY_LONG' END"
    )


def _text(s: str) -> str:
    return (
        f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} < 60 THEN printf('%.1f seconds', {s}) "
        f"WHEN {s} < 3600 THEN printf('%.1f minutes', {s} / 60) "
        f"WHEN {s} < 86400 THEN printf('%.2f hours', {s} / 3600) "
        f"ELSE printf('%.2f days', {s} / 86400) END"
    )


SECONDS = ("seconds_of", "SELECT event_id, value * 997.13::DOUBLE - 10.0 AS seconds FROM events")
USER_SPANS = (
    "spans",
    "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1",
)
MODEL_RECORDS = (
    "records",
    "SELECT concat(CAST(CAST(ts AS DATE) AS VARCHAR), '_', CAST(CAST(ts AS DATE) AS VARCHAR)) "
    "AS folder_name, concat(CAST(CAST(ts AS DATE) AS VARCHAR), 'T23:00:00') AS trained_at, "
    "count(*) AS trained_rows FROM events WHERE day(ts) % 2 = 1 GROUP BY 1, 2",
)
REPORT_FIELDS = (
    "coalesce(CASE WHEN m.folder_name IS NOT NULL THEN 'normal' END, 'unknown') AS mode, "
    "coalesce(m.folder_name, 'unknown') AS folder_name, "
    "coalesce(m.trained_at, 'unknown') AS trained_at, m.trained_rows, "
    "CAST(CASE WHEN m.folder_name IS NOT NULL THEN 16 END AS INTEGER) AS trained_features"
)
PHASES = (
    "phases",
    "SELECT entry, phase, arg_max(status, event_id) AS phase_status, "
    "arg_max(value, event_id) AS phase_sec FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS entry, "
    "event_type AS phase, CASE WHEN value < 1 THEN 'error: small' ELSE 'done' END AS status "
    "FROM events) GROUP BY 1, 2",
)
VIEW_DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"
MODEL_PARTS = (
    "SELECT 'vocab' AS part, col AS name, value, code AS number FROM vocab "
    f"UNION ALL SELECT 'scaler', col, 'mean', round(mean, 6) + 0.0 FROM scaler "
    f"UNION ALL SELECT 'scaler', col, 'scale', round(scale, 6) + 0.0 FROM scaler "
    + " ".join(
        f"UNION ALL SELECT 'centroids', concat('cluster ', cluster), '{i}', round({c}, 6) + 0.0 "
        f"FROM centres{ROUNDS}"
        for i, c in enumerate(FEATURES)
    )
    + " UNION ALL SELECT 'forest', concat('tree ', tree), 'nodes', CAST(count(*) AS DOUBLE) FROM "
    "(SELECT tree, node FROM splits UNION ALL SELECT tree, node FROM leaves) GROUP BY tree"
)

DAILY_NAME = (
    "concat('traffic_', split_part(file_name, '_', 2), "
    "'_00-00-00_(1440.0_minutes)_(0.06_input)_(0.05_output).csv')"
)

ORACLES = {
    "capture_scan": _with(
        [PACKETS],
        f"SELECT {DAILY_NAME} AS file_name, count(*) AS packets, "
        + ", ".join(f"count(nullif(CAST({c} AS VARCHAR), '')) AS {c}_set" for c in RAW_COLUMNS)
        + ", CAST(sum(frame_len) AS BIGINT) AS frame_len_sum FROM packets GROUP BY 1",
    ),
    "date_prune_strict": _with(
        NAMES,
        "SELECT file_name, split_part(file_name, '_', 2) AS capture_date FROM names "
        "WHERE capture_date BETWEEN '2024-01-10' AND '2024-01-20'",
    ),
    "date_prune_lenient": _with(
        [
            (
                "names",
                "SELECT DISTINCT CASE user_id % 5 "
                f"WHEN 0 THEN concat('x_', {VIEW_DAY}, '.csv') "
                f"WHEN 1 THEN concat('x_', replace({VIEW_DAY}, '-0', '-'), '_y.csv') "
                f"WHEN 2 THEN concat('x_', replace({VIEW_DAY}, '-', ''), '_y.csv') "
                "WHEN 3 THEN 'noparts.csv' "
                f"ELSE concat('traffic_', {VIEW_DAY}, '_00-00-00.csv') END AS file_name FROM events",
            )
        ],
        f"SELECT file_name FROM names WHERE regexp_full_match({DATE_FIELD}, "
        "'[0-9]{4}-[0-9]{2}-[0-9]{2}') "
        f"AND try_cast({DATE_FIELD} AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    ),
    "union_by_name": _with(
        [PACKETS],
        "SELECT frame_number, tcp_srcport, tcp_dstport, udp_srcport, udp_dstport FROM packets",
    ),
    "header_union": _with(
        [PACKETS],
        f"SELECT {DAILY_NAME} AS file_name, count(*) AS packets, "
        + ", ".join(
            f"count(nullif(CAST({c} AS VARCHAR), '')) AS {c}_set"
            for c in ("frame_len", "frame_number", "tcp_dstport", "tcp_flags", "tcp_srcport", "udp_dstport", "udp_srcport")
        )
        + ", count(nullif(CASE WHEN udp_srcport IS NOT NULL THEN dns_qry_name END, '')) AS dns_qry_name_set"
        + "".join(f", count(nullif(CASE WHEN udp_srcport IS NULL THEN {c} END, '')) AS {c}_set" for c in ("ip_src", "http_request_uri"))
        + "".join(f", CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in ("frame_number", "udp_srcport", "tcp_srcport"))
        + " FROM packets GROUP BY 1",
    ),
    "empty_input": _with(
        [PACKETS],
        "SELECT range_start, range_end, n = 0 AS skipped, nullif(n, 0) AS training_rows, n = 0 AS raised, nullif(n, 0) AS scoring_rows FROM ("
        "SELECT range_start, range_end, count(p.file_name) AS n FROM "
        "(VALUES ('2024-01-03', '2024-01-05'), ('2024-01-12', '2024-01-12'), ('2023-01-01', '2023-12-31'), ('2030-01-01', '2030-01-02')) "
        "AS r(range_start, range_end) LEFT JOIN packets p ON split_part(p.file_name, '_', 2) BETWEEN range_start AND range_end GROUP BY 1, 2)",
    ),
    "run_records": _with(
        [PACKETS],
        f"SELECT md5(name) AS job_id, name AS csv_file, 'PENDING' AS status, 'queued' AS stage, CAST(0 AS INTEGER) AS progress, "
        "true AS created_utc, true AS no_started_at, true AS no_finished_at, true AS no_result, true AS no_error "
        f"FROM (SELECT DISTINCT {DAILY_NAME} AS name FROM packets)",
    ),
    "mode_presets": "SELECT e.event_type, events, mode, mode_applied, CAST(restarts AS INTEGER) AS restarts, CAST(trees AS INTEGER) AS trees "
    "FROM (SELECT event_type, count(*) AS events FROM events GROUP BY 1) e JOIN (VALUES "
    "('view', 'low', 'low', 5, 50), ('click', 'normal', 'normal', 10, 200), ('purchase', 'hardcore', 'hardcore', 20, 500), "
    "('signup', 'quick', 'normal', 10, 200), ('error', 'HARDCORE', 'normal', 10, 200)) "
    "AS m(event_type, mode, mode_applied, restarts, trees) USING (event_type)",
    "model_roundtrip": _with([*SPLIT_MATRIX, *FOREST_STEPS, *LLOYD_STEPS], MODEL_PARTS),
    "model_folder_name": "SELECT DISTINCT CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date, "
    "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN concat(a, '_', b) "
    "WHEN a IS NOT NULL THEN concat(a, '_to_latest') "
    "WHEN b IS NOT NULL THEN concat('from_earliest_', b) ELSE 'global' END AS folder_name FROM ("
    "SELECT CASE WHEN user_id % 2 = 0 THEN CAST(ts AS DATE) END AS a, "
    "CASE WHEN user_id % 3 = 0 THEN CAST(ts AS DATE) + 1 END AS b FROM events)",
    "timestamp_coerce": _with(
        [PACKETS],
        "SELECT frame_number, epoch_us(try_cast(timestamp AS TIMESTAMP)) AS micros FROM packets",
    ),
    "tcp_flags_normalise": _with(
        [PACKETS],
        "SELECT frame_number, coalesce(nullif(tcp_flags, ''), 'NA') AS tcp_flags FROM packets",
    ),
    "missing_numeric_default": _with(
        [PACKETS],
        "SELECT frame_number, tcp_srcport, CAST(0 AS DOUBLE) AS udp_srcport, "
        "CAST(0 AS DOUBLE) AS udp_dstport FROM packets",
    ),
    "numeric_coerce": _with(
        [PACKETS],
        "SELECT frame_number AS row_id, "
        + ", ".join(f"try_cast({c} AS DOUBLE) AS {c}" for c in STORED_NUMERIC)
        + ", CAST(NULL AS DOUBLE) AS flags_number FROM packets",
    ),
    "categorical_fill": _with([PACKETS, TYPED], f"SELECT row_id, {', '.join(CATEGORICAL)} FROM typed"),
    "numeric_fill": _with([PACKETS, TYPED], f"SELECT row_id, {', '.join(STORED_NUMERIC)} FROM typed"),
    "feature_select": _with(
        ALL,
        f"SELECT row_id, {', '.join(CATEGORICAL)}, {', '.join(STORED_NUMERIC)}, {_r('iat')} FROM scored",
    ),
    "filename_date": _with(
        NAMES,
        f"SELECT file_name, {DATE_FIELD} AS date_field, "
        f"CAST(try_cast({DATE_FIELD} AS DATE) AS VARCHAR) AS capture_date FROM names",
    ),
    "filename_duration": _with(
        NAMES,
        f"SELECT file_name, {MINUTES} * 60 AS seconds, printf('%.1f minutes', {MINUTES}) AS human, "
        f"{_bucket(f'({MINUTES} * 60)')} AS category FROM names",
    ),
    "duration_bucket": _with(
        [SECONDS], f"SELECT event_id, {_bucket('seconds')} AS category FROM seconds_of"
    ),
    "duration_text": _with([SECONDS], f"SELECT event_id, {_text('seconds')} AS human FROM seconds_of"),
    "elapsed_info": _with(
        [
            USER_SPANS,
            (
                "elapsed",
                "SELECT user_id, CAST(epoch_us(last_ts) - epoch_us(first_ts) AS DOUBLE) / 1e6 AS s FROM spans",
            ),
        ],
        f"SELECT user_id, {_r('s', 'seconds')}, {_text('s')} AS human, {_bucket('s')} AS category FROM elapsed",
    ),
    "range_span": _with(
        [
            USER_SPANS,
            (
                "elapsed",
                "SELECT user_id, CAST(date_diff('day', CAST(first_ts AS DATE), CAST(last_ts AS DATE)) "
                "* 86400 + 86399 AS DOUBLE) AS s FROM spans",
            ),
        ],
        f"SELECT user_id, s AS seconds, {_text('s')} AS human, {_bucket('s')} AS category FROM elapsed",
    ),
    "time_order": _with(
        [PACKETS, TYPED],
        "SELECT row_id, row_number() OVER (ORDER BY ts NULLS LAST, row_id) - 1 AS position FROM typed",
    ),
    "inter_arrival_time": _with(ALL, f"SELECT row_id, {_r('iat')} FROM scored"),
    "inter_arrival_stats": _with(
        ALL,
        f"SELECT count(*) AS n, {_r('avg(iat)', 'mean')}, {_r('stddev_pop(iat)', 'deviation')}, "
        f"{_r('max(iat)', 'maximum')} FROM scored",
    ),
    "ordinal_vocab": _with([*ALL, _vocab("scored")], "SELECT col, value, code FROM vocab"),
    "ordinal_encode": _with(
        [*ALL, _vocab("scored"), _coded("codes", "scored")], "SELECT * FROM codes"
    ),
    "ordinal_encode_unseen": _with(
        [
            *ALL,
            _timed("short", _dates(TRAIN_START, SHORT_END)),
            _vocab("short"),
            _coded("codes", "scored"),
        ],
        "SELECT * FROM codes",
    ),
    "scaler_fit": _with(
        [*ALL, _scaler("scored")], f"SELECT col, {_r('mean')}, {_r('scale')} FROM scaler"
    ),
    "scaler_transform": _with(
        [*SPLIT, _scaler("trained"), WIDE_SCALER],
        "SELECT row_id, "
        + ", ".join(_r(f"(s.{c} - mean_{c}) / scale_{c}", c) for c in NUMERIC)
        + " FROM scored s, wide_scaler",
    ),
    "feature_matrix": _with(
        SPLIT_MATRIX, f"SELECT row_id, {', '.join(_r(c) for c in FEATURES)} FROM input"
    ),
    "input_profile": _with(
        [PACKETS],
        f"SELECT count(*) AS num_rows, CAST({len(RAW_COLUMNS)} AS INTEGER) AS n_features FROM packets",
    ),
    "kmeans_fit": _with(
        [*WHOLE_MATRIX, *_restarts("known", MODES["low"]["restarts"], FIT_ROUNDS)],
        "SELECT restart, cost + 0.0 AS cost, cost <= (SELECT min(cost) FROM costs) AS is_best, "
        f"CAST(cluster AS INTEGER) AS cluster, {', '.join(_r(f'{c} + 1e-9', c) for c in FEATURES)} "
        f"FROM try{FIT_ROUNDS} JOIN costs USING (restart)",
    ),
    "kmeans_lloyd": _with(
        [*WHOLE_MATRIX, *LLOYD_STEPS],
        f"SELECT cluster, {', '.join(_r(c) for c in FEATURES)} FROM centres{ROUNDS}",
    ),
    "kmeans_assign": _with(ASSIGN_STEPS, "SELECT row_id, cluster FROM assigned"),
    "kmeans_distance": _with(
        ASSIGN_STEPS, f"SELECT row_id, {_r('sqrt(d2)', 'kmeans_distance')} FROM assigned"
    ),
    "isoforest_fit": _with(
        [*WHOLE_MATRIX, *FOREST_STEPS],
        f"SELECT tree, node, CAST(f AS INTEGER) AS feature, {_r('cut', 'threshold')}, "
        'CAST(2 * node AS INTEGER) AS "left", CAST(2 * node + 1 AS INTEGER) AS "right", depth, '
        "CAST(n_samples AS INTEGER) AS n_samples FROM splits JOIN inner_sizes USING (tree, node) "
        "UNION ALL SELECT tree, node, -1, NULL, NULL, NULL, depth, CAST(n_samples AS INTEGER) FROM leaves",
    ),
    "isoforest_score": _with(ISO_STEPS, f"SELECT row_id, {_r('iso_score')} FROM iso"),
    "isoforest_flag": _with(
        ISO_STEPS, "SELECT iso_score < 0 AS is_anomaly, count(*) AS packets FROM iso GROUP BY 1"
    ),
    "score_summary": _with(SUMMARY_STEPS, "SELECT * FROM summary"),
    "score_report_json": _with(
        [*SUMMARY_STEPS, MODEL_RECORDS],
        f"SELECT s.*, {REPORT_FIELDS} FROM summary s "
        "LEFT JOIN records m ON m.folder_name = '2024-01-15_2024-01-15'",
    ),
    "report_with_model": _with(
        [
            MODEL_RECORDS,
            (
                "reports",
                "SELECT concat(CAST(CAST(ts AS DATE) AS VARCHAR), '_', CAST(CAST(ts AS DATE) AS VARCHAR)) "
                "AS model_folder, count(*) AS rows, max(value) AS kmeans_distance_max FROM events GROUP BY 1",
            ),
        ],
        f"SELECT r.model_folder, r.rows, r.kmeans_distance_max, {REPORT_FIELDS} "
        "FROM reports r LEFT JOIN records m ON m.folder_name = r.model_folder",
    ),
    "training_log_latest": _with(
        [
            PHASES,
            (
                "starts",
                f"SELECT {VIEW_DAY} AS entry, max(event_id) FILTER (event_type = 'signup') AS start "
                "FROM events GROUP BY 1",
            ),
            (
                "current",
                f"SELECT {VIEW_DAY} AS entry, e.* FROM events e JOIN starts s ON s.entry = "
                f"{VIEW_DAY} WHERE start IS NULL OR event_id >= start",
            ),
            (
                "fields",
                "SELECT entry, arg_max(CASE event_type WHEN 'signup' THEN 'running' ELSE event_type "
                "END, event_id) FILTER (event_type <> 'view') AS status, "
                "arg_max(user_id, event_id) FILTER (event_id % 3 = 0) AS num_rows, "
                "arg_max(value, event_id) FILTER (event_type = 'purchase') AS elapsed_sec "
                "FROM current GROUP BY 1",
            ),
        ],
        "SELECT entry, status, num_rows, elapsed_sec, phase, phase_status, phase_sec "
        "FROM fields JOIN phases USING (entry)",
    ),
    "phase_share": _with(
        [
            PHASES,
            ("totals", "SELECT entry, sum(phase_sec) AS total FROM phases GROUP BY 1"),
        ],
        f"SELECT entry, phase, phase_sec AS time_sec, {_r('total', 'total_sec')}, "
        f"{_r('phase_sec / nullif(total, 0)', 'share')} FROM phases JOIN totals USING (entry)",
    ),
    "run_history_latest": "SELECT CAST(user_id AS VARCHAR) AS job_id, "
    "arg_max(CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' "
    "WHEN 'purchase' THEN 'FINISHED' WHEN 'error' THEN 'ERROR' END, event_id) "
    "FILTER (event_type <> 'view') AS status, "
    "arg_max(CAST(ts AS VARCHAR), event_id) FILTER (event_type = 'click') AS started_at, "
    "arg_max(CAST(ts AS VARCHAR), event_id) FILTER (event_type IN ('purchase', 'error')) AS finished_at, "
    "arg_max(value, event_id) FILTER (event_type = 'purchase') AS duration_seconds, "
    "arg_max(concat('failed at ', CAST(ts AS VARCHAR)), event_id) FILTER (event_type = 'error') AS error "
    "FROM events GROUP BY user_id",
    "run_error_duration": _with(
        [
            (
                "failed",
                "SELECT event_id, event_type, CASE WHEN event_id % 4 <> 0 THEN CAST(epoch_us(ts) - "
                "epoch_us(min(ts) OVER (PARTITION BY user_id)) AS DOUBLE) / 1e6 END AS s FROM events",
            )
        ],
        f"SELECT event_id, {_r('coalesce(s, 0)', 'duration_seconds')}, "
        f"coalesce({_text('s')}, '0 seconds') AS duration_human, "
        f"{_bucket('coalesce(s, 0)')} AS duration_category FROM failed WHERE event_type = 'error'",
    ),
    "train_small": "SELECT 'global' AS folder_name, 'low' AS mode, count(*) AS num_rows, "
    f"CAST({len(RAW_COLUMNS)} AS INTEGER) AS n_features FROM events",
    "analyse_range": "SELECT 'FINISHED' AS status, count(*) AS rows, 'low' AS mode, "
    f"'{TRAIN_START}_{TRAIN_END}' AS folder_name, "
    f"count(*) FILTER (CAST(ts AS DATE) BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_END}') "
    f"AS trained_rows, CAST({len(RAW_COLUMNS)} AS INTEGER) AS trained_features, "
    "CAST(31 * 86400 - 1 AS DOUBLE) AS duration_seconds, '31.00 days' AS duration_human, "
    "'VERY_LONG' AS duration_category FROM events",
}
