"""DuckDB twins of the named queries (same column names and types).

The SQL is written out per query; shared pieces (fixtures, unpivot, the
histogram bin rule, md5 draws, ten-significant-digit rounding) are
generated from the same constants the Spark side uses.
"""

from __future__ import annotations

from synthlens.operators.synth import NO_REPLY, RULE, SESSION_RELATIONS
from synthlens.plans import fixtures as fx
from synthlens.plans import queries as q

FEATS = fx.FLOW_FEATURES
BINS = 30
DUMMY = "255.255.255.255:1"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sig(x: str, digits: int = 10) -> str:
    e = f"floor(log10(abs({x})))"
    s = f"pow(10.0::DOUBLE, abs({e}))"
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) = 0 THEN 0.0::DOUBLE "
            f"WHEN isnan({x}) OR isinf({x}) THEN ({x}) "
            f"WHEN {e} >= 0 THEN round(({x}) / {s}, {digits - 1}) * {s} "
            f"ELSE round(({x}) * {s}, {digits - 1}) / {s} END)")


def with_(ctes: dict[str, str], body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


def unpivot(src: str, feats=FEATS, ids=()) -> str:
    idl = "".join(f"{i}, " for i in ids)
    return " UNION ALL ".join(f"SELECT {idl}'{f}' AS feature, {f} AS x FROM {src} WHERE {f} IS NOT NULL"
                              for f in feats)


def feat_pos(feats=FEATS) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(feats)) + ") t(pos, feature)"


def bin_expr(x="x", lo="lo", hi="hi", bins=BINS) -> str:
    b0 = f"least({bins - 1}, CAST(floor(({x} - {lo}) / ({hi} - {lo}) * {float(bins)}::DOUBLE) AS INTEGER))"
    width = f"(({hi} - {lo}) / {float(bins)}::DOUBLE)"
    left = f"(CAST({b0} AS DOUBLE) * {width} + {lo})"
    right = f"(CASE WHEN {b0} + 1 = {bins} THEN {hi} ELSE CAST({b0} + 1 AS DOUBLE) * {width} + {lo} END)"
    return (f"({b0} - (CASE WHEN {x} < {left} THEN 1 ELSE 0 END) "
            f"+ (CASE WHEN {b0} < {bins - 1} AND {x} >= {right} THEN 1 ELSE 0 END))")


def edge_expr(k: str, lo="lo", hi="hi", bins=BINS) -> str:
    return f"(CASE WHEN {k} = {bins} THEN {hi} ELSE CAST({k} AS DOUBLE) * (({hi} - {lo}) / {float(bins)}::DOUBLE) + {lo} END)"


def hist_ctes(p_src: str, q_src: str, prefix: str = "") -> dict[str, str]:
    """CTEs ``{prefix}ranges, {prefix}binned, {prefix}aligned`` for a pair."""
    r, b, a = f"{prefix}ranges", f"{prefix}binned", f"{prefix}aligned"
    long_pq = f"SELECT 'p' AS grp, feature, x FROM ({unpivot(p_src)}) UNION ALL SELECT 'q', feature, x FROM ({unpivot(q_src)})"
    return {
        f"{prefix}long": long_pq,
        r: f"SELECT pos, feature, min(x) AS lo, max(x) AS hi FROM {prefix}long JOIN ({feat_pos()}) USING (feature) "
           f"GROUP BY pos, feature",
        b: f"SELECT l.feature, l.grp, {bin_expr('l.x', 'r.lo', 'r.hi')} AS bin FROM {prefix}long l "
           f"JOIN {r} r USING (feature) WHERE r.hi > r.lo",
        a: f"SELECT s.feature, s.bin, {edge_expr('s.bin', 's.lo', 's.hi')} AS lo_edge, "
           f"{edge_expr('s.bin + 1', 's.lo', 's.hi')} AS hi_edge, "
           f"CAST(coalesce(c.n_p, 0) AS BIGINT) AS n_p, CAST(coalesce(c.n_q, 0) AS BIGINT) AS n_q "
           f"FROM (SELECT feature, lo, hi, CAST(t.b AS INTEGER) AS bin FROM {r}, range({BINS}) t(b) WHERE hi > lo) s "
           f"LEFT JOIN (SELECT feature, bin, count(*) FILTER (WHERE grp = 'p') AS n_p, "
           f"count(*) FILTER (WHERE grp = 'q') AS n_q FROM {b} GROUP BY feature, bin) c USING (feature, bin)",
    }


def jsd_body(prefix: str = "") -> str:
    a, r = f"{prefix}aligned", f"{prefix}ranges"
    return (f"SELECT r.feature, CASE WHEN r.hi > r.lo THEN round(v.v, 5) ELSE 0.0::DOUBLE END AS jsd "
            f"FROM {r} r LEFT JOIN (SELECT feature, 0.5 * (sum(ph * ln(ph / m)) + sum(qh * ln(qh / m))) AS v FROM ("
            f"SELECT feature, ph, qh, 0.5 * (ph + qh) AS m FROM ("
            f"SELECT feature, dp / sum(dp) OVER (PARTITION BY feature) AS ph, dq / sum(dq) OVER (PARTITION BY feature) AS qh "
            f"FROM (SELECT feature, n_p / (hi_edge - lo_edge) / sum(n_p) OVER (PARTITION BY feature) + 1e-10 AS dp, "
            f"n_q / (hi_edge - lo_edge) / sum(n_q) OVER (PARTITION BY feature) + 1e-10 AS dq FROM {a}))) "
            f"GROUP BY feature) v USING (feature)")


def jsd_sql(p_src: str, q_src: str, extra: dict[str, str] | None = None) -> str:
    return with_({**(extra or {}), **hist_ctes(p_src, q_src)}, jsd_body())


FLOWS = {"flows": fx.FLOWS_SQL}
REAL = "(SELECT * FROM flows WHERE grp = 'F' AND label = 'ssh')"
P = "(SELECT * FROM flows WHERE grp = 'F')"
Q = "(SELECT * FROM flows WHERE grp = 'O')"


def unit(key: str, part: int) -> str:
    return f"((CAST(('0x' || substr(md5({key}), {1 + 8 * part}, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def baseline_sql(seed: int, noise: float, real: str = REAL) -> str:
    """Rows ``(id, features...)`` of the Gaussian baseline (md5 draws)."""
    prof = ", ".join(f"avg({f}) AS m{i}, stddev_samp({f}) AS s{i}, min({f}) AS lo{i}, max({f}) AS hi{i}"
                     for i, f in enumerate(FEATS))
    cols = []
    for i, f in enumerate(FEATS):
        bias = f"(2.0 * {unit(lit(f'{seed}:{f}:bias'), 0)} - 1.0)"
        key = f"({lit(f'{seed}:{f}:')} || CAST(id AS VARCHAR))"
        z = f"(sqrt(-2.0 * ln({unit(key, 0)})) * cos(6.283185307179586 * {unit(key, 1)}))"
        v = f"(m{i} + {bias} + s{i} * {noise!r} * {z})"
        cols.append(f"least(greatest({v}, lo{i}), hi{i}) AS {f}")
    return (f"SELECT id, {', '.join(cols)} FROM (SELECT row_number() OVER () - 1 AS id FROM {real}), "
            f"(SELECT {prof} FROM {real})")


def sel_sig(cols, sig_cols) -> str:
    return ", ".join(f"{sig(c)} AS {c}" if c in sig_cols else c for c in cols)


ENDPOINT = "coalesce(\"Destination\", 'nan') || ':' || CAST(\"Destination Port\" AS VARCHAR)"
PREDS = {"preds": fx.PREDS_SQL, "p": f"SELECT *, {ENDPOINT} AS endpoint FROM preds"}
VOTED = {**PREDS,
         "votes": "SELECT endpoint, CAST(count_if(prediction = 'ssh') AS BIGINT) AS n_ssh, "
                  "CAST(count_if(prediction = 'non-ssh') AS BIGINT) AS n_non FROM p "
                  f"WHERE endpoint <> '{DUMMY}' GROUP BY endpoint",
         "voted": "SELECT p.*, coalesce(CASE WHEN n_ssh > n_non THEN 'ssh' WHEN n_ssh IS NOT NULL THEN 'non-ssh' END, "
                  "prediction) AS final FROM p LEFT JOIN votes USING (endpoint)"}
CONF = ("CAST(count_if(truth = 'ssh' AND final = 'ssh') AS BIGINT) AS tp, "
        "CAST(count_if(truth <> 'ssh' AND final = 'ssh') AS BIGINT) AS fp, "
        "CAST(count_if(truth = 'ssh' AND final <> 'ssh') AS BIGINT) AS fn, "
        "CAST(count_if(truth <> 'ssh' AND final <> 'ssh') AS BIGINT) AS tn")


def prf(src: str) -> str:
    return (f"SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) "
            f"ELSE 0.0 END AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
            f"CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM {src})")


# replies: parsed objects derived from events directly (independent of the parser)
ITEMS = ("SELECT batch, pos, f1, f2 FROM (SELECT event_id // 20 + 1 AS batch, "
         "row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1 AS pos, "
         f"count(*) OVER (PARTITION BY event_id // 20) AS c, CAST({fx.REPLY_F1_SQL} AS DOUBLE) AS f1, "
         f"CAST({fx.REPLY_F2_SQL} AS DOUBLE) AS f2 FROM events) WHERE batch % 6 IN (0, 1, 2) OR (batch % 6 = 3 AND pos < c - 1)")
PARSED = ("SELECT batch, CAST(CASE WHEN batch % 6 IN (0, 1, 2) THEN c WHEN batch % 6 = 3 THEN c - 1 ELSE 0 END AS BIGINT) "
          "AS parsed FROM (SELECT event_id // 20 + 1 AS batch, count(*) AS c FROM events GROUP BY 1)")


def full(src: str) -> str:
    """Batches of the first three shapes, numbered from 1."""
    return f"SELECT * REPLACE (batch // 6 * 3 + batch % 6 AS batch) FROM ({src}) WHERE batch % 6 < 3"


def plan_sql(n_sql: str, b: int = 20) -> str:
    return (f"SELECT batch, CAST(least({b}, n - (batch - 1) * {b}) AS BIGINT) AS request_n, "
            f"CAST(nb AS BIGINT) AS n_batches FROM (SELECT unnest(generate_series(1, nb)) AS batch, n, nb "
            f"FROM (SELECT n, CAST(ceil(n / {float(b)}) AS BIGINT) AS nb FROM ({n_sql})))")


EVENTS_N = "SELECT count(*) AS n FROM events"
def accounting(run: str, parsed: str, items: str, n_sql: str, b: int = q.REQUEST) -> dict[str, str]:
    """The tables of one run, prefixed by its name: what each batch was asked
    for and gave, and the first records of each."""
    return {
        f"{run}_parsed": parsed, f"{run}_plan": plan_sql(n_sql, b),
        f"{run}_d": f"SELECT p.batch, coalesce(q.parsed, 0) AS parsed, (SELECT n FROM ({n_sql})) AS n "
                    f"FROM {run}_plan p LEFT JOIN {run}_parsed q USING (batch)",
        f"{run}_s": f"SELECT batch, parsed, n, least(parsed, {b}) AS cap, "
                    f"sum(least(parsed, {b})) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS s FROM {run}_d",
        f"{run}_acc": "SELECT batch, CAST(parsed AS BIGINT) AS parsed, "
                      f"CAST(greatest(0, least({b}, n - least(n, s - cap))) AS BIGINT) AS requested, "
                      f"CAST(least(n, s) - least(n, s - cap) AS BIGINT) AS accepted, CAST(least(n, s) AS BIGINT) AS total, "
                      f"'{run}' AS run FROM {run}_s",
        f"{run}_first": f"SELECT i.batch, i.pos, i.f1, i.f2, run FROM ({items}) i JOIN {run}_acc a USING (batch) "
                        f"WHERE i.pos < a.accepted",
    }


RUNS = {**accounting("all", PARSED, ITEMS, f"SELECT count(*) * {q.REQUEST} // 20 AS n FROM events"),
        **accounting("full", full(PARSED), full(ITEMS), "SELECT count(*) * 3 // 10 - 7 AS n FROM events")}
ACCOUNTING = {**RUNS, "acc": "SELECT * FROM all_acc UNION ALL SELECT * FROM full_acc"}
TAKE_FIRST = {**RUNS, "first": "SELECT batch, pos, f1, f2 FROM all_first"}

WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_expr(t: str) -> str:
    sp = strip("p")
    part = (f"CASE WHEN starts_with({sp}, 'json') THEN {strip(f'substr({sp}, 5)')} "
            f"ELSE {strip('p')} END")
    first = f"list_filter(list_transform(string_split({t}, '```'), lambda p: {part}), lambda p: starts_with(p, '['))[1]"
    return f"(CASE WHEN strpos({t}, '```') > 0 THEN coalesce({first}, {t}) ELSE {t} END)"


def slice_expr(c: str) -> str:
    e = f"(CASE WHEN strpos(reverse({c}), ']') = 0 THEN 0 ELSE length({c}) - strpos(reverse({c}), ']') + 1 END)"
    s = f"strpos({c}, '[')"
    return f"(CASE WHEN {s} > 0 AND {e} > 0 THEN (CASE WHEN {e} >= {s} THEN substr({c}, {s}, {e} - {s} + 1) ELSE '' END) ELSE {c} END)"


def fmt4(x: str) -> str:
    return f"printf('%.4f', ({x}) + 0.0)"


def prompt_sql() -> str:
    specs = "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {lit(s.key)}, {lit(s.name)}, {lit(s.description)})" for i, s in enumerate(q.FLOW_SPECS)) + \
        ") t(pos, feature, name, description)"
    stats = (f"SELECT feature, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min_v, max(x) AS max_v, "
             f"quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 "
             f"FROM ({unpivot(REAL)}) GROUP BY feature")
    line = (f"'feature ' || feature || ' (' || name || '): ' || description || chr(10) || '  mean ' || {fmt4('mean')} "
            f"|| ', std ' || {fmt4('std')} || ', min ' || {fmt4('min_v')} || ', max ' || {fmt4('max_v')} "
            f"|| ', quartiles ' || {fmt4('q1')} || ' ' || {fmt4('q2')} || ' ' || {fmt4('q3')}")
    keys = ", ".join(s.key for s in q.FLOW_SPECS)
    prompt = (f"'Produce ' || CAST(request_n AS VARCHAR) || ' synthetic session records as a JSON array (batch ' "
              f"|| CAST(batch AS VARCHAR) || ' of ' || CAST(n_batches AS VARCHAR) || ').' || chr(10) || "
              f"{lit(RULE + chr(10) + 'Profile of the real sessions (statistics only, no real records):' + chr(10))} "
              f"|| profile_text || {lit(chr(10) + RULE + chr(10) + SESSION_RELATIONS + chr(10) + RULE + chr(10) + 'Reply with a JSON array of ')} "
              f"|| CAST(request_n AS VARCHAR) || {lit(' objects with the keys ' + keys + ' and nothing else.')}")
    return with_({**FLOWS, "specs": specs, "stats": stats,
                  "block": f"SELECT string_agg({line}, chr(10) ORDER BY pos) AS profile_text FROM stats JOIN specs USING (feature)",
                  "plan": plan_sql(f"SELECT count(*) AS n FROM {REAL}")},
                 f"SELECT batch, request_n, {prompt} AS prompt FROM plan, block")


def hexbin_sql() -> str:
    nx, ny = 35, 20
    ext = ("SELECT grp, x0 - 1e-9 * (x1 - x0) AS xmin, x1 + 1e-9 * (x1 - x0) AS xmax, y0 AS ymin, y1 AS ymax FROM ("
           "SELECT grp, CASE WHEN a = b AND a = 0 THEN -0.1 WHEN a = b THEN a - 0.1 * abs(a) ELSE a END AS x0, "
           "CASE WHEN a = b AND a = 0 THEN 0.1 WHEN a = b THEN b + 0.1 * abs(b) ELSE b END AS x1, "
           "CASE WHEN c = d AND c = 0 THEN -0.1 WHEN c = d THEN c - 0.1 * abs(c) ELSE c END AS y0, "
           "CASE WHEN c = d AND c = 0 THEN 0.1 WHEN c = d THEN d + 0.1 * abs(d) ELSE d END AS y1 FROM ("
           "SELECT grp, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM pts GROUP BY grp))")
    idx = (f"SELECT grp, (x - xmin) / ((xmax - xmin) / {float(nx)}) AS ix, (y - ymin) / ((ymax - ymin) / {float(ny)}) AS iy "
           f"FROM pts JOIN ext USING (grp)")
    cell = ("SELECT grp, ix, iy, round_even(ix, 0) AS ix1, round_even(iy, 0) AS iy1, floor(ix) AS ix2, floor(iy) AS iy2 FROM idx")
    pick = ("SELECT grp, CASE WHEN d1 < d2 THEN 1 ELSE 2 END AS lattice, "
            "CAST(CASE WHEN d1 < d2 THEN ix1 ELSE ix2 END AS INTEGER) AS i, "
            "CAST(CASE WHEN d1 < d2 THEN iy1 ELSE iy2 END AS INTEGER) AS j FROM ("
            "SELECT *, (ix - ix1) * (ix - ix1) + 3.0 * ((iy - iy1) * (iy - iy1)) AS d1, "
            "(ix - ix2 - 0.5) * (ix - ix2 - 0.5) + 3.0 * ((iy - iy2 - 0.5) * (iy - iy2 - 0.5)) AS d2 FROM cell)")
    pts = embedding_sql()
    return (f"WITH pts AS ({pts}), ext AS ({ext}), idx AS ({idx}), cell AS ({cell}), pick AS ({pick})\n"
            "SELECT grp, lattice, i, j, count(*) AS n FROM pick GROUP BY ALL")


def embedding_sql() -> str:
    """The two leading axes by squaring the covariance of the standardised
    features (a power iteration of 2^50 steps, the sum of the diagonal kept at
    1), the second after the first is taken out. The square's column with the
    largest diagonal is the axis, its largest entry positive."""
    k = len(FEATS)
    cells = [(i, j) for i in range(k) for j in range(k)]
    feats = ", ".join(FEATS)
    z = ", ".join(f"CASE WHEN s{i} > 0 AND s{j} > 0 THEN c{min(i, j)}{max(i, j)} / (s{i} * s{j}) ELSE 0.0 END AS z{i}{j}"
                  for i, j in cells)

    def squared(name: str, src: str) -> dict[str, str]:
        a = ", ".join(f"a{i}{j}" for i, j in cells)
        trace = " + ".join(f"{{0}}{i}{i}" for i in range(k))
        square = ", ".join(f"{' + '.join(f'a{i}{m} * a{m}{j}' for m in range(k))} AS b{i}{j}" for i, j in cells)
        best = [f"a{i}{i} >= greatest({', '.join(f'a{j}{j}' for j in range(i + 1, k))})" for i in range(k - 1)]
        axis = ", ".join("CASE " + " ".join(f"WHEN {c} THEN a{i}{m} / sqrt(a{m}{m})" for m, c in enumerate(best))
                         + f" ELSE a{i}{k - 1} / sqrt(a{k - 1}{k - 1}) END AS v{i}" for i in range(k))
        return {f"{name}(n, {a})": f"SELECT 0, {', '.join(f'z{i}{j} / ({trace.format(chr(122))})' for i, j in cells)} FROM {src} "
                                   f"UNION ALL SELECT n + 1, {', '.join(f'b{i}{j} / ({trace.format(chr(98))})' for i, j in cells)} "
                                   f"FROM (SELECT n, {square} FROM {name}) WHERE n < 50",
                f"{name}_axis": f"SELECT {axis}, {a} FROM {name} WHERE n = 50"}

    top = " + ".join(f"a{i}{j} * z{i}{j}" for i, j in cells)
    left = ", ".join(f"z{i}{j} - l * a{i}{j} AS z{i}{j}" for i, j in cells)
    u = (f"SELECT 'real' AS grp, {feats} FROM {REAL} UNION ALL SELECT 'other', {feats} FROM flows WHERE grp = 'O' AND label = 'ssh' "
         f"UNION ALL SELECT 'baseline', {feats} FROM base")
    st = ("SELECT " + ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(FEATS)) + ", "
          + ", ".join(f"covar_samp({FEATS[i]}, {FEATS[j]}) AS c{i}{j}" for i, j in cells if i <= j) + " FROM u")
    point = [" + ".join(f"CASE WHEN s{i} > 0 THEN ({f} - m{i}) / s{i} ELSE 0.0 END * {t}.v{i}" for i, f in enumerate(FEATS))
             for t in ("p_axis", "q_axis")]
    ctes = {**FLOWS, "base": baseline_sql(q.SEED + 1, 1.03), "u": u, "st": st, "z": f"SELECT {z} FROM st", **squared("p", "z"),
            "rest": f"SELECT {left} FROM (SELECT *, {top} AS l FROM z, p_axis)", **squared("q", "rest")}
    cols = ", ".join(f"round(({e}) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE + 0.0 AS {c}" for e, c in zip(point, "xy"))
    return with_(ctes, f"SELECT grp, {cols} FROM u, st, p_axis, q_axis", recursive=True)


def box_sql() -> str:
    long = unpivot("flows", ids=["grp"])
    qq = ("SELECT grp, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, "
          "quantile_cont(x, 0.75) AS q3 FROM long GROUP BY grp, feature")
    body = ("SELECT grp, feature, count(*) AS n, q1, med, q3, "
            "least(q1, coalesce(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), q1)) AS whislo, "
            "greatest(q3, coalesce(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), q3)) AS whishi "
            "FROM long JOIN qq USING (grp, feature) GROUP BY grp, feature, q1, med, q3")
    return with_({**FLOWS, "long": long, "qq": qq, "b": body},
                 f"SELECT grp, feature, n, {sel_sig(['q1', 'med', 'q3', 'whislo', 'whishi'], {'q1', 'med', 'q3', 'whislo', 'whishi'})} FROM b")


def pc_sql() -> str:
    k = len(FEATS)
    cov = ", ".join(f"covar_samp({FEATS[i]}, {FEATS[j]}) AS c{i}{j}" for i in range(k) for j in range(k))
    w = ", ".join(f"{' + '.join(f'c{i}{j} * v{j}' for j in range(k))} AS w{i}" for i in range(k))
    vs = ", ".join(f"v{i}" for i in range(k))
    nrm = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in range(k)) + ")"
    init = ", ".join("0.5::DOUBLE" for _ in range(k))
    steps = 100
    pick = "CASE " + " ".join(
        f"WHEN abs(v{i}) >= greatest({', '.join(f'abs(v{j})' for j in range(i + 1, k))}) THEN v{i}" if i < k - 1 else ""
        for i in range(k - 1)) + f" ELSE v{k - 1} END"
    proj = "0.0 + " + " + ".join(f"{f} * a{i}" for i, f in enumerate(FEATS))
    ctes = {**FLOWS,
            "cov": f"SELECT {cov} FROM {P}",
            f"it(k, {vs})": f"SELECT 0, {init} UNION ALL SELECT k + 1, "
                            + ", ".join(f"w{i} / nrm" for i in range(k))
                            + f" FROM (SELECT k, {', '.join(f'w{i}' for i in range(k))}, {nrm} AS nrm FROM "
                            f"(SELECT k, {w} FROM it, cov)) WHERE k < {steps}",
            "ev": f"SELECT {vs}, CASE WHEN ({pick}) < 0 THEN -1.0 ELSE 1.0 END AS s FROM it WHERE k = {steps}",
            "ax": "SELECT " + ", ".join(f"s * v{i} AS a{i}" for i in range(k)) + " FROM ev",
            "pc": f"SELECT grp, {', '.join(FEATS)}, {proj} AS pc FROM flows, ax WHERE grp IN ('F', 'O')",
            "rng": "SELECT min(pc) AS mn, max(pc) AS mx FROM pc WHERE grp = 'F'"}
    body = (f"SELECT grp, {', '.join(FEATS)}, "
            + sig("100.0 * (pc - mn) / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END", 7) + " AS PC FROM pc, rng")
    sql = "WITH RECURSIVE " + ",\n".join(f"{n if '(' in n else n} AS ({v})" for n, v in ctes.items()) + "\n" + body
    return sql


def transfer_sql() -> str:
    return ("SELECT session, bytes_sent, bytes_recv, duration, CASE WHEN bytes_recv = 0 THEN NULL ELSE bytes_sent / bytes_recv END AS ratio, "
            "CASE WHEN duration = 0 THEN NULL ELSE bytes_sent / duration END AS speed FROM ("
            "SELECT session, sum(CASE WHEN sent THEN bytes ELSE 0.0 END) AS bytes_sent, "
            "sum(CASE WHEN sent THEN 0.0 ELSE bytes END) AS bytes_recv, "
            "(max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration FROM packets GROUP BY session)")


GAPS = ("SELECT session, pid, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, pid)) / 1e6 "
        "AS gap FROM packets")
IPA = ("SELECT session, count(*) AS n_packets, avg(gap) AS ipa_mean, var_pop(gap) AS ipa_var, "
       "(max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration "
       "FROM (SELECT session, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, pid)) / 1e6 "
       "AS gap FROM packets) GROUP BY session")
CONN = ("SELECT dst, total, n_sources, total / n_sources AS avg_per_source FROM ("
        "SELECT dst, count(*) AS total, count(DISTINCT src) AS n_sources FROM conns GROUP BY dst)")


def viol(a: str, e: str, tol: float = q.TOL) -> str:
    return f"abs({a} - ({e})) / greatest(abs({a}), abs({e}), 1e-12) > {tol!r}"


def build() -> dict[str, str]:
    S: dict[str, str] = {}
    fl = ", ".join(FEATS)
    S["scan_csv_indexed"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders"
    S["scan_csv"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
    S["scan_clean"] = with_({"dirty": fx.DIRTY_SQL},
                            "SELECT event_id, user_id, event_type, value FROM dirty WHERE value IS NOT NULL AND isfinite(value)")
    S["dataset_catalog"] = (
        "SELECT 'flows' AS dataset, s.split, 'lineitem' AS dir, s.file, 4 AS n_features, 'label' AS label_col, "
        "CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows FROM (VALUES ('train', 'grp=F'), ('test', 'grp=O')) s(split, file) "
        "LEFT JOIN (SELECT 'grp=' || l_linestatus AS file, count(*) AS n FROM lineitem GROUP BY 1) c USING (file)")
    S["first_available_source"] = ("SELECT 2 AS chosen, 0 AS fallback, o_orderkey, o_totalprice FROM orders UNION ALL "
                                   "SELECT 0, 1, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
    S["csv_roundtrip"] = with_(FLOWS, f"SELECT grp, label, {fl} FROM flows")
    S["completion_source"] = with_({"responses": fx.RESPONSES_SQL, "plan": plan_sql(EVENTS_N)},
                                   "SELECT p.batch, p.request_n, r.response, CASE WHEN r.response IS NULL THEN 0 ELSE 1 END "
                                   f"AS has_reply, CASE WHEN r.response IS NULL THEN {lit(NO_REPLY)} END AS error FROM plan p "
                                   "LEFT JOIN (SELECT * FROM responses WHERE batch % 9 <> 0) r USING (batch)")
    holes = "SELECT * REPLACE (CASE WHEN l_tax >= 0.02 THEN l_quantity END AS l_quantity) FROM flows"
    S["load_audit"] = with_({**FLOWS, "h": holes}, f"SELECT 'baseline' AS source, count(*) AS n_total, count(*) AS n_label, "
                            f"count(*) AS n_complete, count(*) AS n_selected, 1 AS simulated FROM {REAL} UNION ALL " + " UNION ALL ".join(
        f"SELECT '{g}' AS source, count(*) AS n_total, CAST(count_if(label = 'ssh') AS BIGINT) AS n_label, "
        f"CAST(count_if(label = 'ssh' AND {' AND '.join(f'{f} IS NOT NULL' for f in FEATS)}) AS BIGINT) AS n_complete, "
        f"CAST(least(count_if(label = 'ssh' AND {' AND '.join(f'{f} IS NOT NULL' for f in FEATS)}), {q.SAMPLE_N}) AS BIGINT) "
        f"AS n_selected, 0 AS simulated FROM h WHERE grp = '{g}'" for g in ("F", "O")))
    S["load_synthetic_a"] = with_({**FLOWS, "h": holes}, f"SELECT {sig('l_quantity / 100.0 * 100.0')} AS l_quantity, "
                                  f"0.0::DOUBLE AS l_extendedprice, {sig('l_discount * 100.0')} AS l_discount, "
                                  f"{sig('l_tax * 100.0')} AS l_tax FROM h WHERE label = 'ssh' AND l_quantity IS NOT NULL")
    S["feature_projection"] = with_(FLOWS, f"SELECT {fl} FROM flows")
    S["label_filter_exact"] = with_(FLOWS, "SELECT * FROM flows WHERE label = 'ssh'")
    S["label_filter_ci"] = (f"SELECT label, {fl} FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'SSH' WHEN 'A' THEN 'Ssh' "
                            f"ELSE 'non-ssh' END AS label, {fl} FROM lineitem) WHERE lower(label) = 'ssh'")
    S["label_column_resolve"] = with_(FLOWS, "SELECT * FROM (SELECT *, CASE WHEN grp = 'F' THEN 'ssh' ELSE 'non-ssh' END "
                                             "AS status_label FROM flows) WHERE status_label = 'ssh'")
    S["drop_incomplete"] = with_({"dirty": fx.DIRTY_SQL},
                                 "SELECT event_id, user_id, event_type, value FROM dirty WHERE value IS NOT NULL AND isfinite(value)")
    S["drop_incomplete_subset"] = with_({"dirty": fx.DIRTY_SQL},
                                        "SELECT * FROM dirty WHERE value IS NOT NULL AND NOT isnan(value)")
    S["inf_to_null"] = with_({"dirty": fx.DIRTY_SQL},
                             "SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM dirty")
    S["fill_missing_features"] = with_(FLOWS, "SELECT grp, label, l_quantity, l_extendedprice, l_discount, "
                                               "0.0::DOUBLE AS l_tax FROM flows")
    S["default_endpoint"] = with_(FLOWS, "SELECT grp, label, '0.0.0.0' AS \"Destination\", 0 AS \"Destination Port\" "
                                         "FROM flows WHERE grp = 'F' UNION ALL SELECT grp, 'ssh', '255.255.255.255', 1 "
                                         "FROM flows WHERE grp = 'O'")
    resc = []
    for part, a, b in (("small", "l_discount", "l_tax"), ("large", "l_quantity", "l_discount")):
        flag = f"coalesce((SELECT max(greatest({a}, {b})) FROM flows) <= 2.0, false)"
        resc.append(f"SELECT '{part}' AS part, {sig(f'CASE WHEN {flag} THEN {a} * 100.0 ELSE {a} END')} AS a, "
                    f"{sig(f'CASE WHEN {flag} THEN {b} * 100.0 ELSE {b} END')} AS b FROM flows")
    S["auto_rescale"] = with_(FLOWS, " UNION ALL ".join(resc))
    bounds = ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(FEATS))
    S["clip_to_profile"] = with_(FLOWS, "SELECT grp, " + ", ".join(
        sig(f"greatest(least({f} * 1.2::DOUBLE, hi{i} * 1.05::DOUBLE), lo{i} * 0.95::DOUBLE)") + f" AS {f}"
        for i, f in enumerate(FEATS)) + f" FROM flows, (SELECT {bounds} FROM {REAL})")
    S["endpoint_key"] = with_({"preds": fx.PREDS_SQL}, "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN \"Destination\" "
                              "END, 'nan') || ':' || CAST(\"Destination Port\" AS VARCHAR) AS endpoint FROM preds JOIN "
                              "(SELECT o_orderkey, o_orderstatus FROM orders) USING (o_orderkey)")
    S["cast_features"] = ("SELECT event_id, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS v, "
                          "TRY_CAST(event_type AS DOUBLE) AS t FROM events")
    S["required_feature_check"] = with_({"items": ITEMS},
                                        "SELECT pos, feature, CAST(CASE feature WHEN 'f1' THEN n1 WHEN 'f2' THEN n2 ELSE 0 END AS BIGINT) AS n_present, "
                                        "n AS n_rows FROM (VALUES (0, 'f1'), (1, 'f2'), (2, 'f3')) t(pos, feature), "
                                        "(SELECT count(*) AS n, count(f1) AS n1, count(f2) AS n2 FROM items)")
    S["profile_join"] = with_({**FLOWS, "prof": f"SELECT feature, avg(x) AS mean, stddev_samp(x) AS std FROM ({unpivot(REAL)}) GROUP BY feature"},
                              f"SELECT grp, feature, x, round((x - mean) / std, 8) + 0.0 AS z FROM ({unpivot('flows', ids=['grp'])}) JOIN prof USING (feature)")
    S["vote_join_back"] = with_(VOTED, "SELECT o_orderkey, endpoint, truth, prediction, final FROM voted")
    rng = "(SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM flows WHERE grp = 'F')"
    S["train_scalar_apply"] = with_(FLOWS, f"SELECT l_extendedprice, {sig('100.0 * (l_extendedprice - mn) / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END')} AS scaled FROM flows, {rng} WHERE grp = 'O'")
    S["histogram_align"] = with_({**FLOWS, **hist_ctes(P, Q)},
                                 f"SELECT feature, bin, {sig('lo_edge')} AS lo_edge, {sig('hi_edge')} AS hi_edge, n_p, n_q FROM aligned")
    S["metric_pivot"] = with_(FLOWS, f"SELECT feature, {sig("avg(x) FILTER (WHERE grp = 'F')")} AS mean_f, "
                                     f"{sig("avg(x) FILTER (WHERE grp = 'O')")} AS mean_o "
                                     f"FROM ({unpivot('flows', ids=['grp'])}) GROUP BY feature")
    desc_cols = ["mean", "std", "min_v", "q1", "q2", "q3", "max_v"]
    S["describe_profile"] = with_({**FLOWS, "d": "SELECT grp, feature, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, "
                                                 "min(x) AS min_v, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, "
                                                 "quantile_cont(x, 0.75) AS q3, max(x) AS max_v FROM ("
                                                 + unpivot("flows", ids=["grp"]) + ") GROUP BY grp, feature"},
                                  f"SELECT grp, feature, n, {sel_sig(desc_cols, set(desc_cols))} FROM d")
    S["group_means"] = with_(FLOWS, f"SELECT grp, feature, {sig('avg(x)')} AS mean FROM ({unpivot('flows', ids=['grp'])}) GROUP BY grp, feature")
    S["group_stds"] = with_(FLOWS, f"SELECT grp, feature, {sig('stddev_samp(x)')} AS std FROM ({unpivot('flows', ids=['grp'])}) GROUP BY grp, feature")
    pairs = [(i, j) for i in range(len(FEATS)) for j in range(i, len(FEATS))]
    S["covariance_matrix"] = with_(FLOWS, " UNION ALL ".join(
        f"SELECT '{FEATS[i]}' AS fi, '{FEATS[j]}' AS fj, {sig(f'covar_samp({FEATS[i]}, {FEATS[j]})')} AS cov FROM {P}"
        for i, j in pairs))
    S["joint_range"] = with_({**FLOWS, **hist_ctes(P, Q)}, f"SELECT feature, {sig('lo')} AS lo, {sig('hi')} AS hi FROM ranges")
    S["feature_histogram"] = with_({**FLOWS, **hist_ctes(P, Q)}, "SELECT feature, grp, bin, count(*) AS n FROM binned GROUP BY ALL")
    S["jsd"] = jsd_sql(P, Q, FLOWS)
    a_ctes = hist_ctes(REAL, "(SELECT * FROM flows WHERE grp = 'O' AND label = 'ssh')", "a_")
    b_ctes = hist_ctes(REAL, "baseline_b", "b_")
    S["jsd_summary"] = with_(
        {**FLOWS, "baseline_b": baseline_sql(q.SEED + 2, 1.08), **a_ctes, **b_ctes,
         "ja": jsd_body("a_"), "jb": jsd_body("b_"),
         "pair": "SELECT feature, ja.jsd AS jsd_a, jb.jsd AS jsd_b FROM ja JOIN jb USING (feature)"},
        f"SELECT feature, {sig('jsd_a')} AS jsd_a, {sig('jsd_b')} AS jsd_b, CASE WHEN jsd_a < jsd_b THEN 'A' "
        f"WHEN jsd_b < jsd_a THEN 'B' ELSE 'tie' END AS winner FROM pair UNION ALL "
        f"SELECT '__mean__', {sig('avg(jsd_a)')}, {sig('avg(jsd_b)')}, CASE WHEN avg(jsd_a) < avg(jsd_b) THEN 'A' ELSE 'B' END FROM pair")
    S["majority_vote"] = with_(PREDS, "SELECT endpoint, CAST(count_if(prediction = 'ssh') AS BIGINT) AS n_ssh, "
                                      "CAST(count_if(prediction = 'non-ssh') AS BIGINT) AS n_non, "
                                      "CASE WHEN count_if(prediction = 'ssh') > count_if(prediction = 'non-ssh') THEN 'ssh' "
                                      f"ELSE 'non-ssh' END AS majority FROM p WHERE endpoint <> '{DUMMY}' GROUP BY endpoint")
    S["confusion_counts"] = with_(VOTED, f"SELECT {CONF} FROM voted")
    S["precision_recall_f1"] = with_({**VOTED, "c": f"SELECT {CONF} FROM voted", "m": prf("c")},
                                     f"SELECT tp, fp, fn, {sig('precision')} AS precision, {sig('recall')} AS recall, "
                                     f"{sig('f1')} AS f1 FROM m")
    runs = {**PREDS,
            "r": "SELECT 'high' AS mode, year(o_orderdate) AS run, endpoint, truth, prediction FROM p UNION ALL "
                 "SELECT 'urgent', year(o_orderdate), endpoint, truth, CASE WHEN o_orderpriority = '1-URGENT' THEN 'ssh' "
                 "ELSE 'non-ssh' END FROM p",
            "e": f"SELECT *, CASE WHEN endpoint <> '{DUMMY}' THEN mode || '|' || CAST(run AS VARCHAR) || '|' || endpoint END AS ep FROM r",
            "v": "SELECT ep, CASE WHEN count_if(prediction = 'ssh') > count_if(prediction = 'non-ssh') THEN 'ssh' "
                 "ELSE 'non-ssh' END AS major FROM e WHERE ep IS NOT NULL GROUP BY ep",
            "voted": "SELECT e.*, coalesce(v.major, e.prediction) AS final FROM e LEFT JOIN v USING (ep)",
            "c": f"SELECT mode, run, {CONF} FROM voted GROUP BY mode, run", "m": prf("c")}
    S["repeat_average"] = with_(runs, f"SELECT mode, {sig('avg(precision)')} AS precision, {sig('avg(recall)')} AS recall, "
                                      f"{sig('avg(f1)')} AS f1, count(*) AS runs FROM m GROUP BY mode")
    S["box_stats"] = box_sql()
    S["hexbin_density"] = hexbin_sql()
    S["embedding_2d"] = embedding_sql()
    S["group_counts"] = with_(FLOWS, "SELECT grp, count(*) AS n FROM flows GROUP BY grp")
    S["batch_outcomes"] = with_(ACCOUNTING, "SELECT run, count(*) AS planned, CAST(count_if(requested > 0 AND parsed = 0) AS BIGINT) "
                                            "AS failed, CAST(sum(accepted) AS BIGINT) AS accepted FROM acc GROUP BY run")
    S["batch_accounting"] = with_(ACCOUNTING, "SELECT * FROM acc")
    S["take_first_per_batch"] = with_(RUNS, "SELECT * FROM all_first UNION ALL SELECT * FROM full_first")
    S["ipa_gaps"] = with_({"packets": fx.PACKETS_SQL}, f"SELECT session, pid, {sig('gap')} AS gap FROM ({GAPS}) WHERE gap IS NOT NULL")
    S["exact_sample"] = (f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('{q.SEED}:' || CAST(o_orderkey AS VARCHAR) || ':1'), "
                         f"o_orderkey LIMIT {q.SAMPLE_N}")
    S["sample_sentinel"] = ("SELECT 'all' AS mode, o_orderkey, o_totalprice FROM orders UNION ALL "
                            f"SELECT 'n300', o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY "
                            f"md5('{q.SEED}:' || CAST(o_orderkey AS VARCHAR) || ':1'), o_orderkey LIMIT 300)")
    ks = [f"CAST(round({f} * 100) AS BIGINT)" for f in FEATS]
    key = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in ks)
    S["cap_rows"] = with_(FLOWS, f"SELECT {fl} FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(ks)} ORDER BY {', '.join(FEATS)}) AS cp "
                          f"FROM {REAL}) ORDER BY md5('{q.SEED}:' || {key} || ':' || CAST(cp AS VARCHAR)) LIMIT {q.SAMPLE_N}")
    hundred = ", ".join(f"CAST(round(CAST({c} AS DOUBLE) * 100) AS BIGINT) AS {c}" for c in ("l_discount", "l_tax"))
    S["exact_sample_repeated"] = (
        f"SELECT l_discount, l_tax FROM (SELECT *, row_number() OVER (PARTITION BY l_discount, l_tax) AS cp FROM "
        f"(SELECT {hundred} FROM lineitem)) ORDER BY md5('{q.SEED}:' || CAST(l_discount AS VARCHAR) || ':' || "
        f"CAST(l_tax AS VARCHAR) || ':' || CAST(cp AS VARCHAR)) LIMIT {q.SAMPLE_N}")
    # the label follows the quantity: a fitted forest gives the label itself, and the vote works on that
    S["rf_predict"] = ("SELECT label, label AS prediction FROM (SELECT CASE WHEN l_quantity > 25 THEN 'ssh' ELSE 'non-ssh' END "
                       "AS label FROM lineitem WHERE l_linestatus = 'O')")
    S["detection_experiment"] = (
        "WITH t AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (l_quantity > 25) AS a, count(*) FILTER (l_quantity <= 25) AS d "
        "FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), "
        "c AS (SELECT CAST(sum(CASE WHEN a > d THEN a ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN a > d THEN d ELSE 0 END) AS fp, "
        "sum(CASE WHEN a > d THEN 0 ELSE a END) AS fn FROM t), "
        "m AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c) "
        f"SELECT unnest(['original', 'baseline_a', 'baseline_b']) AS mode, {sig('p')} AS precision, {sig('r')} AS recall, "
        f"{sig('2.0 * p * r / (p + r)')} AS f1, CAST(10 AS BIGINT) AS runs FROM m")
    S["augment_union"] = with_({**FLOWS, "bl": baseline_sql(q.SEED + 1, 1.03)},
                               f"SELECT grp, label, {sel_sig(FEATS, set(FEATS))}, '0.0.0.0' AS \"Destination\", 0 AS \"Destination Port\" "
                               f"FROM flows WHERE grp = 'F' UNION ALL SELECT NULL, 'ssh', {sel_sig(FEATS, set(FEATS))}, "
                               f"'255.255.255.255', 1 FROM bl")
    S["labelled_union"] = with_({**FLOWS, "bl": baseline_sql(q.SEED + 1, 1.03)},
                                f"SELECT {sel_sig(FEATS, set(FEATS))}, 'real' AS grp FROM {REAL} UNION ALL "
                                f"SELECT {sel_sig(FEATS, set(FEATS))}, 'other' FROM {Q} UNION ALL "
                                f"SELECT {sel_sig(FEATS, set(FEATS))}, 'baseline' FROM bl")
    S["reply_clean"] = with_({"responses": fx.RESPONSES_SQL, "t": f"SELECT batch, {strip('response')} AS t FROM responses"},
                             f"SELECT batch, {clean_expr('t')} AS cleaned FROM t")
    S["reply_slice"] = with_({"responses": fx.RESPONSES_SQL, "t": f"SELECT batch, {strip('response')} AS t FROM responses",
                              "c": f"SELECT batch, {clean_expr('t')} AS c FROM t"},
                             f"SELECT batch, {slice_expr('c')} AS sliced FROM c")
    S["reply_parse"] = ITEMS
    S["batch_plan"] = with_(FLOWS, plan_sql(f"SELECT count(*) AS n FROM {REAL}"))
    S["prompt_text"] = prompt_sql()
    rb = ("SELECT min(f1) AS lo1, max(f1) AS hi1, min(f2) AS lo2, max(f2) AS hi2 FROM (" + fx.REAL_REPLY_SQL + ")")
    S["assemble_synthetic"] = with_(
        {**TAKE_FIRST, "rb": rb,
         "clipped": "SELECT batch, pos, greatest(least(f1, hi1 * 1.05::DOUBLE), lo1 * 0.95::DOUBLE) AS f1, "
                    "greatest(least(f2, hi2 * 1.05::DOUBLE), lo2 * 0.95::DOUBLE) AS f2 FROM first, rb "
                    "WHERE f1 IS NOT NULL AND f2 IS NOT NULL",
         "numbered": "SELECT *, row_number() OVER (PARTITION BY f1, f2 ORDER BY batch, pos) AS cp FROM clipped"},
        f"SELECT batch, pos, f1, f2 FROM numbered ORDER BY md5('{q.SEED}:' || CAST(f1 AS VARCHAR) || ':' || "
        "CAST(f2 AS VARCHAR) || ':' || CAST(cp AS VARCHAR)) LIMIT (SELECT count(*) // 4 FROM events)")
    S["gaussian_baseline"] = with_(FLOWS, f"SELECT id, {sel_sig(FEATS, set(FEATS))} FROM ({baseline_sql(q.SEED + 1, 1.03)})")
    S["record_audit"] = with_(
        {**TAKE_FIRST, "rb": rb,
         "per": "SELECT batch, count(*) AS n_records, CAST(count_if(f1 IS NULL OR f2 IS NULL) AS BIGINT) AS n_missing, "
                "CAST(count_if(f1 <= 0 OR f2 <= 0) AS BIGINT) AS n_nonpositive, "
                "CAST(count_if(f1 < lo1 OR f1 > hi1 OR f2 < lo2 OR f2 > hi2) AS BIGINT) AS n_out_of_range "
                "FROM first, rb GROUP BY batch",
         "vb": "SELECT f1, f2, batch, count(*) AS c FROM first WHERE f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY f1, f2, batch",
         "vt": "SELECT f1, f2, sum(c) AS t FROM vb GROUP BY f1, f2",
         "dup": "SELECT batch, CAST(sum(c) AS BIGINT) AS n_duplicate FROM vb JOIN vt USING (f1, f2) WHERE t > 1 GROUP BY batch"},
        "SELECT batch, n_records, n_missing, n_nonpositive, n_out_of_range, CAST(coalesce(n_duplicate, 0) AS BIGINT) "
        "AS n_duplicate FROM per LEFT JOIN dup USING (batch)")
    rq = "(SELECT min(l_quantity) AS mn, max(l_quantity) AS mx FROM flows WHERE grp = 'F')"
    S["minmax_scale"] = with_(FLOWS, f"SELECT l_quantity, {sig('100.0 * (l_quantity - mn) / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END')} AS scaled FROM flows, {rq} WHERE grp = 'F'")
    S["pc_feature"] = pc_sql()
    st = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(FEATS))
    S["standardize"] = with_(FLOWS, "SELECT grp, " + ", ".join(
        f"round(CASE WHEN s{i} > 0 THEN ({f} - m{i}) / s{i} ELSE 0.0 END, 8) + 0.0 AS {f}" for i, f in enumerate(FEATS))
        + f" FROM flows, (SELECT {st} FROM flows)")
    S["feature_correlation"] = with_(FLOWS, f"SELECT grp, {sig('corr(l_quantity, l_extendedprice)')} AS corr, count(*) AS n "
                                            "FROM flows GROUP BY grp")
    S["connection_stats"] = with_({"conns": fx.CONNS_SQL, "cs": CONN},
                                  f"SELECT dst, total, n_sources, {sig('avg_per_source')} AS avg_per_source FROM cs")
    S["connection_sketches"] = with_({"conns": fx.CONNS_SQL, "cs": CONN}, "SELECT dst, total, n_sources, 1 AS within FROM cs")
    S["transfer_stats"] = with_({"packets": fx.PACKETS_SQL, "t": transfer_sql()},
                                f"SELECT session, {sel_sig(['bytes_sent', 'bytes_recv', 'duration', 'ratio', 'speed'], {'bytes_sent', 'bytes_recv', 'duration', 'ratio', 'speed'})} FROM t")
    S["ipa_stats"] = with_({"packets": fx.PACKETS_SQL, "i": IPA},
                           f"SELECT session, n_packets, {sig('ipa_mean')} AS ipa_mean, {sig('ipa_var')} AS ipa_var FROM i")
    S["session_time"] = with_({"packets": fx.PACKETS_SQL, "i": IPA},
                              f"SELECT session, n_packets, {sig('duration')} AS duration, {sig('ipa_mean')} AS ipa_mean, "
                              f"CASE WHEN abs(duration - (n_packets - 1) * ipa_mean) <= {q.TOL!r} * greatest(1.0, duration) "
                              f"THEN 1 ELSE 0 END AS residual_ok FROM i")
    cols = ["total", "n_sources", "avg_per_source"]
    lo_hi = ", ".join(f"min(ln(1.0 + {c})) AS lo{i}, max(ln(1.0 + {c})) AS hi{i}" for i, c in enumerate(cols))
    S["log_scale"] = with_({"conns": fx.CONNS_SQL, "cs": CONN},
                           "SELECT dst, " + ", ".join(
                               sig(f"100.0 * (ln(1.0 + {c}) - lo{i}) / CASE WHEN hi{i} > lo{i} THEN hi{i} - lo{i} ELSE 1.0 END")
                               + f" AS {c}" for i, c in enumerate(cols)) + f" FROM cs, (SELECT {lo_hi} FROM cs)")
    S["session_type"] = with_({"packets": fx.PACKETS_SQL, "t": transfer_sql()},
                              f"SELECT session, {sig('ratio')} AS ratio, CASE WHEN ratio > 1.0 THEN 'bulk_upload' "
                              "WHEN ratio >= 0.3 AND ratio <= 0.7 THEN 'interactive' WHEN ratio >= 0.1 AND ratio < 0.3 "
                              "THEN 'remote_exec' ELSE 'other' END AS session_type FROM t")
    def wrong(col: str, key: str, every: int, times: float) -> str:
        return f"{col} * CASE WHEN {key} % {every} = 0 THEN {times!r}::DOUBLE ELSE 1.0::DOUBLE END AS {col}"

    rules = [("R1", "c", "n_sources > 0", "avg_per_source", "total / n_sources"),
             ("R2", "s", "duration > 0", "speed", "bytes_sent / duration"),
             ("R3", "s", "bytes_recv > 0", "ratio", "bytes_sent / bytes_recv"),
             ("R4", "own", "n_packets > 1", "ipa_mean", "gap_sum / (n_packets - 1)"),
             ("R5", "own", "n_packets > 1", "ipa_var", "gap_square / (n_packets - 1)"),
             ("R6", "s", "ipa_mean IS NOT NULL", "duration", "(n_packets - 1) * ipa_mean")]
    S["coherence_audit"] = with_(
        {"conns": fx.CONNS_SQL, "cs": CONN, "packets": fx.PACKETS_SQL, "t": transfer_sql(), "i": IPA, "g": GAPS,
         "c": f"SELECT dst, total, n_sources, {wrong('avg_per_source', 'dst', 10, 1.5)} FROM cs",
         "s": f"SELECT session, bytes_sent, bytes_recv, t.duration, n_packets, {wrong('speed', 'session', 7, 2.0)}, "
              f"{wrong('ratio', 'session', 11, 1.5)}, {wrong('ipa_mean', 'session', 13, 1.1)}, "
              f"{wrong('ipa_var', 'session', 5, 2.0)} FROM t JOIN i USING (session)",
         "own": "SELECT session, n_packets, ipa_mean, ipa_var, sum(gap) AS gap_sum, "
                "sum((gap - ipa_mean) * (gap - ipa_mean)) AS gap_square FROM g JOIN s USING (session) "
                "WHERE gap IS NOT NULL GROUP BY ALL"},
        " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS checked, CAST(count_if({viol(x, y)}) AS BIGINT) "
                           f"AS violations FROM {src} WHERE {cond}" for rule, src, cond, x, y in rules))
    scatter = (f"SELECT 1 FROM {REAL} UNION ALL SELECT 1 FROM {REAL} UNION ALL "
               f"SELECT 1 FROM flows WHERE grp = 'O' AND label = 'ssh'")
    report = {
        "jsd": S["jsd"], "histogram": S["feature_histogram"], "box": S["box_stats"], "hexbin": S["hexbin_density"],
        "scatter": with_(FLOWS, scatter), "load_audit": S["load_audit"],
    }
    S["report_tables"] = " UNION ALL ".join(f"SELECT '{k}' AS report, count(*) AS n_rows FROM ({v})" for k, v in report.items())
    return S


ORACLE_SQL = build()
