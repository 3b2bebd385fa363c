"""Query: the whole price context of hourly bars, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.frames import DAY, HOUR
from chronoloom.operators import price_context as pc
from chronoloom.plans.registry import BARS, bars, query

_S = pc.ContextSettings()
E = "1e-12"


def _frame(us: int, end: int = 0) -> str:
    return f"(PARTITION BY k ORDER BY epoch_us(t) RANGE BETWEEN {us - 1} PRECEDING AND {'CURRENT ROW' if not end else f'{end} PRECEDING'})"


def _clip(x: str, low: str = "0", high: str = "1") -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {low}), {high}) END)"


def _bps(now: str, before: str) -> str:
    return f"(CASE WHEN {now} > 0 AND {before} > 0 THEN 1e4 * ln({now} / {before}) END)"


def _sql() -> str:
    h1 = _S.core[0]
    q, p, f, tr, al, j, v, lists, out = [], [], [], [], [], [], [], [], []
    for h in _S.quality:
        n, w = _S.bars(h), _frame(h * HOUR)
        q += [f"sum(valid) OVER {w} AS price_obs_count_{h}h", f"{n} AS price_expected_count_{h}h", f"{_clip(f'1 - sum(valid) OVER {w} / {n}')} AS price_missing_ratio_{h}h",
              f"CASE WHEN max(gap) OVER {w} > 0 OR sum(valid) OVER {w} < {n} THEN 1 ELSE 0 END AS price_gap_flag_{h}h", f"max(outlier) OVER {w} AS price_outlier_flag_{h}h", f"sum(valid) OVER {w} >= {_S.valid_share} * {n} AS ok{h}"]
        out += [f"price_obs_count_{h}h", f"price_expected_count_{h}h", f"price_missing_ratio_{h}h", f"price_gap_flag_{h}h", f"price_outlier_flag_{h}h"]
    for h in _S.returns:
        before = f"last_value(c IGNORE NULLS) OVER (PARTITION BY k ORDER BY epoch_us(t) RANGE BETWEEN {h * HOUR + int(1.05 * HOUR)} PRECEDING AND {h * HOUR} PRECEDING)"
        p.append(f"CASE WHEN ok{h} THEN {_bps('c', before)} END AS past_return_{h}h_bps")
        out.append(f"past_return_{h}h_bps")
    for h in _S.core:
        w, ok, ret = _frame(h * HOUR), f"ok{h}", f"past_return_{h}h_bps"
        f += [f"CASE WHEN {ok} THEN sqrt(sum(ret * ret) OVER {w}) END AS realized_vol_{h}h_bps", f"CASE WHEN {ok} THEN sqrt(sum(ret * ret) OVER {w} / {h}) END AS realized_vol_{h}h_per_sqrt_hour_bps",
              f"CASE WHEN {ok} THEN {_bps(f'max(h) OVER {w}', f'min(l) OVER {w}')} END AS range_width_{h}h_bps",
              f"count(y) OVER {w} AS n{h}", f"regr_sxx(y, x) OVER {w} AS sxx{h}", f"regr_syy(y, x) OVER {w} AS syy{h}", f"regr_sxy(y, x) OVER {w} AS sxy{h}", f"sum(abs(ret)) OVER {w} AS path{h}",
              f"sum((ret > 0)::INT) OVER {w} AS up{h}", f"sum((ret < 0)::INT) OVER {w} AS down{h}", f"count(ret) OVER {w} AS nr{h}"]
        block = dict(_S.blocks)[h]
        b = [f"b{block}_{k}" for k in range(max(1, h // block))]
        f += [f"{_bps(f'lag(c, {k * block}) OVER o', f'lag(c, {(k + 1) * block}) OVER o')} AS b{h}_{k}" for k in range(len(b))]
        known = " + ".join(f"coalesce((abs(b{h}_{k}) > 1e-8)::INT, 0)" for k in range(len(b)))
        same = " + ".join(f"coalesce((abs(b{h}_{k}) > 1e-8 AND sign(b{h}_{k}) = sign({ret}))::INT, 0)" for k in range(len(b)))
        t = [f"range_width_{h}h_bps / (realized_vol_{h}h_bps + {E}) AS range_to_vol_{h}h", f"CASE WHEN {ok} AND n{h} >= 3 THEN sxy{h} / (sxx{h} + {E}) END AS trend_slope_{h}h",
             f"CASE WHEN {ok} AND n{h} >= 3 THEN sxy{h} / (sxx{h} + {E}) / (sqrt(greatest(syy{h} - sxy{h} * sxy{h} / (sxx{h} + {E}), 0) / greatest(n{h} - 2, 1) / (sxx{h} + {E})) + {E}) END AS trend_slope_tstat_{h}h",
             f"CASE WHEN {ok} AND n{h} >= 3 THEN {_clip(f'sxy{h} * sxy{h} / (sxx{h} * syy{h} + {E})')} END AS trend_r2_{h}h", f"CASE WHEN {ok} THEN {_clip(f'abs({ret}) / (path{h} + {E})')} END AS trend_efficiency_{h}h",
             f"abs({ret}) / (realized_vol_{h}h_bps + {E}) AS trend_snr_{h}h", f"CASE WHEN {ret} IS NULL THEN NULL WHEN abs({ret}) <= 1e-8 THEN 0.0 ELSE sign({ret}) END::DOUBLE AS trend_direction_{h}h",
             f"CASE WHEN abs({ret}) > 1e-8 THEN CASE WHEN {ret} > 0 THEN up{h} ELSE down{h} END / (nr{h} + {E}) END AS bar_direction_align_{h}h",
             f"CASE WHEN abs({ret}) > 1e-8 AND ({known}) > 0 THEN ({same}) / (({known}) + {E}) END AS block_direction_align_{h}h"]
        tr += t
        al += [f"{_clip(f'0.35 * trend_efficiency_{h}h + 0.35 * (1 - exp(-trend_snr_{h}h / 2)) + 0.3 * (1 - exp(-abs(trend_slope_tstat_{h}h) / 2))')} AS trend_strength_{h}h",
               f"{_clip(f'0.4 * bar_direction_align_{h}h + 0.4 * block_direction_align_{h}h + 0.2 * trend_r2_{h}h')} AS trend_consistency_{h}h"]
        j += [f"CASE WHEN {ok} THEN max(ret_outlier_z) OVER {w} END AS max_jump_z_{h}h", f"CASE WHEN {ok} THEN sum(CASE WHEN ret_outlier_z > 5 THEN 1 ELSE 0 END) OVER {w} END AS jump_count_{h}h",
              f"CASE WHEN {ok} THEN {_clip(f'(sum(ret * ret) OVER {w} - pi() / 2 * sum(two) OVER {w}) / (sum(ret * ret) OVER {w} + {E})')} END AS jump_ratio_bv_{h}h",
              f"CASE WHEN {ok} THEN arg_max(ret, (abs(ret), -epoch_us(t))) FILTER (ret IS NOT NULL) OVER {w} END AS signed_max_jump_return_{h}h_bps"]
        v.append(f"CASE WHEN {ok} THEN 0.5 * (1 - exp(-coalesce(max_jump_z_{h}h, 0) / 2)) + 0.3 * coalesce(jump_ratio_bv_{h}h, 0) + 0.2 * (1 - exp(-coalesce(jump_count_{h}h, 0) / 2)) END AS jump_proxy_{h}h")
        out += [f"realized_vol_{h}h_bps", f"realized_vol_{h}h_per_sqrt_hour_bps", f"range_width_{h}h_bps", *(x.rsplit(" AS ", 1)[1] for x in t), f"trend_strength_{h}h", f"trend_consistency_{h}h",
                f"max_jump_z_{h}h", f"jump_count_{h}h", f"jump_ratio_bv_{h}h", f"signed_max_jump_return_{h}h_bps", f"jump_proxy_{h}h"]
        width = f"range_width_{h}h_bps"
        lists.append(f"list({width}) FILTER ({width} IS NOT NULL) OVER m AS r{h}")
        out.append(f"CASE WHEN len(r{h}) >= 20 AND {width} IS NOT NULL THEN 1 - (len(list_filter(r{h}, lambda z: z < {width})) + (len(list_filter(r{h}, lambda z: z = {width})) - 1) / 2) / (len(r{h}) - 1) END AS range_compression_{h}h")
    for h in _S.vol_of_vol:
        w, x = _frame(h * HOUR), f"realized_vol_{h1}h_bps"
        enough = f"ok{h} AND count({x}) OVER {w} >= {-(-_S.bars(h) * 4 // 5)}"
        v += [f"CASE WHEN {enough} THEN stddev_pop({x}) OVER {w} / (avg({x}) OVER {w} + {E}) END AS vol_of_vol_{h}h", f"CASE WHEN {enough} THEN stddev_pop({x}) OVER {w} END AS vol_of_vol_abs_{h}h"]
        out += [f"vol_of_vol_{h}h", f"vol_of_vol_abs_{h}h"]
    robust = [f"realized_vol_{h}h_bps AS realized_vol_{h}h_z" for h in _S.core] + [f"vol_of_vol_{h}h AS vol_of_vol_{h}h_z" for h in _S.vol_of_vol]
    for x in robust:
        value, name = x.split(" AS ")
        lists.append(f"quantile_cont(p_{name}, [0.25, 0.5, 0.75]) OVER m AS q_{name}, count(p_{name}) OVER m AS c_{name}")
        out.append(f"CASE WHEN c_{name} >= 20 THEN {_clip(f'({value} - q_{name}[2]) / (q_{name}[3] - q_{name}[1] + {E})', '-5', '5')} END AS {name}")
    lagged = ", ".join("lag({}) OVER o AS p_{}".format(*x.split(" AS ")) for x in robust)
    return f"""WITH {BARS},
  a AS (SELECT k, t, open::DOUBLE AS op, high::DOUBLE AS h, low::DOUBLE AS l, close::DOUBLE AS c, CASE WHEN close > 0 THEN ln(close) END AS y, {_bps("close", "lag(close) OVER o")} AS ret, CASE WHEN epoch_us(t) - epoch_us(lag(t) OVER o) > {HOUR} THEN 1 ELSE 0 END AS gap FROM bars WINDOW o AS (PARTITION BY k ORDER BY t)),
  b AS (SELECT *, CASE WHEN op > 0 AND h > 0 AND l > 0 AND c > 0 AND h >= greatest(op, h, l, c) AND l <= least(op, h, l, c) THEN 1.0 ELSE 0.0 END::DOUBLE AS valid, lag(ret) OVER o AS prev, CASE WHEN c > 0 THEN epoch_us(t) / {HOUR}.0 - 473352 END AS x FROM a WINDOW o AS (PARTITION BY k ORDER BY t)),
  s AS (SELECT *, CASE WHEN count(prev) OVER w >= 20 THEN greatest((quantile_cont(prev, 0.75) OVER w - quantile_cont(prev, 0.25) OVER w) / 1.349, {E}) END AS ret_robust_sigma_bps FROM b WINDOW w AS {_frame(7 * DAY)}),
  z AS (SELECT *, abs(ret) / (ret_robust_sigma_bps + {E}) AS ret_outlier_z, abs(ret * prev) AS two FROM s),
  g AS (SELECT *, CASE WHEN ret_outlier_z > 5 THEN 1 ELSE 0 END AS outlier FROM z),
  q AS (SELECT *, {", ".join(q)} FROM g), p AS (SELECT *, {", ".join(p)} FROM q),
  f AS (SELECT *, {", ".join(f)} FROM p WINDOW o AS (PARTITION BY k ORDER BY t)),
  tr AS (SELECT *, {", ".join(tr)}, {", ".join(j)} FROM f), al AS (SELECT *, {", ".join(al)} FROM tr), v AS (SELECT *, {", ".join(v)} FROM al),
  n AS (SELECT *, {lagged} FROM v WINDOW o AS (PARTITION BY k ORDER BY t)),
  m AS (SELECT *, {", ".join(lists)} FROM n WINDOW m AS {_frame(30 * DAY)}),
  r AS (SELECT k, t AS time, t AS price_feature_time, 0.0::DOUBLE AS price_feature_age_min, ret_robust_sigma_bps, ret_outlier_z, {", ".join(out)} FROM m)
  SELECT k, time, price_feature_time, round(COLUMNS(lambda c: c NOT IN ('k', 'time', 'price_feature_time') AND NOT contains(c, 'expected_count') AND NOT contains(c, 'flag') AND NOT contains(c, 'jump_count') AND NOT contains(c, 'compression')), 4) + 0.0, COLUMNS('.*(expected_count|flag|jump_count).*'), round(COLUMNS('.*compression.*'), 10) + 0.0 FROM r"""


@query(_sql())
def price_context_full(spark, sf_dir):
    """All features of the price context of hourly bars, at the published spans."""
    d = pc.context_features(bars(spark, sf_dir), ["k"], "t")
    exact = {c: F.round(c, 10) + F.lit(0.0) for c in d.columns if "compression" in c}  # shares of counts, which tie at few digits
    return d.select(*[exact[c].alias(c) if c in exact else (F.round(c, 4) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in d.dtypes])
