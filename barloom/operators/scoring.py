"""Row-wise scores over company rows: Column expressions only, so they stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import fixed_values as fv
from barloom.functions.folds import adx_latest, ema_latest, macd_latest, rsi_wilder, trend_latest
from barloom.functions.scalars import (
    clamp, clip01, clip_range, drop_nulls, half_up, is_true, number, ratio, signed_percent, weighted_mean,
)

SQRT10 = math.sqrt(10)


def field(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column, or a typed null where this row shape does not have it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


# ---- pre-result score ----------------------------------------------------------------------------

def timing_component(days: Column) -> Column:
    return (F.when(days < 2, 0.1).when(days < 5, 0.5).when(days <= 15, 1.0).when(days <= 25, 0.7)
            .when(days.isNotNull(), 0.4))


def participation_component(rvol: Column, up_down: Column, qty_ratio: Column, pct_change: Column) -> Column:
    """Volume and delivery evidence. Very high volume counts as neutral, more often an end than a start."""
    volume = F.when(rvol > 4, F.lit(0.5)).otherwise(clip01((rvol - 0.9) / 0.8))
    mixed = F.when(up_down.isNull(), volume).otherwise(0.75 * volume + 0.25 * clip01((up_down - 0.8) / 1.2))
    share = F.when(pct_change.isNull(), F.lit(0.15)).otherwise(0.3 * clip01(0.5 + pct_change / 20.0))
    delivered = 0.7 * clip01((qty_ratio - 0.9) / 0.8) + share
    return weighted_mean([(0.6, mixed), (0.4, delivered)])


def history_component(n: Column, drift: Column, hit_rate: Column) -> Column:
    """Drift before past results, pulled to neutral while there are few of them."""
    shrink = n / (n + 4)
    hit = (F.coalesce(hit_rate, F.lit(0.0)) * n + 2) / (n + 4)
    value = 0.5 * clip01(0.5 + shrink * F.coalesce(drift, F.lit(0.0)) / 0.06) + 0.5 * hit
    return F.when(n >= 2, value)


def liquidity_component(adv: Column, vol_ann: Column) -> Column:
    base = clip01((F.log10(F.greatest(adv, F.lit(0.1))) - 0.3) / 1.7)
    damp = F.when(vol_ann > 0.6, F.greatest(F.lit(0.4), 1 - (vol_ann - 0.6))).otherwise(F.lit(1.0))
    return F.when(adv.isNotNull(), base * damp)


def pre_result_score(rows: DataFrame) -> DataFrame:
    """Adds components, extension, score (0..100) and stage; drops nothing.

    Sector-relative strength is used when present, market-relative strength otherwise.
    """
    c = lambda name: number(field(rows, name))
    has_sector = c("rel_sec_5d").isNotNull()
    pick = lambda k: F.when(has_sector, c(f"rel_sec_{k}d")).otherwise(c(f"rel_mkt_{k}d"))
    sigma = F.when(c("sigma_daily") != 0, c("sigma_daily"))
    first = rows.select(
        "*",
        F.when(has_sector, F.lit("sec")).otherwise(F.lit("mkt")).alias("rel_base"),
        ((0.5 * pick(5) + 0.3 * pick(10) + 0.2 * F.coalesce(pick(20), pick(10))) / (sigma * SQRT10)).alias("rs_z"),
        (c("accel") / (sigma * SQRT10)).alias("accel_z"),
    )
    days = field(rows, "trading_days_left", "int")
    parts = {
        "timing": timing_component(days),
        "rel_strength": clip01((F.col("rs_z") + 0.25) / 1.5),
        "acceleration": clip01((F.col("accel_z") + 0.5) / 2.0),
        "participation": participation_component(
            c("rvol_5d"), c("updown_vol_ratio"), c("deliv_qty_ratio"), c("deliv_pct_change")),
        "history": history_component(
            field(rows, "hist_events", "long"), c("hist_pre_excess_mean"), c("hist_pre_hit_rate")),
        "fundamentals": c("fund_score") / 100,
        "catalysts": clip01(0.5 + 0.5 * c("catalyst_score")),
        "liquidity": liquidity_component(c("adv20_cr"), c("vol_ann")),
    }
    extension = F.greatest(
        F.lit(0.0),
        F.coalesce(clip01((c("z_20d") - 1.5) / 1.5), F.lit(0.0)),
        F.coalesce(clip01((c("rsi14") - 70) / 15), F.lit(0.0)),
    )
    second = first.select(
        "*", *[v.alias(f"comp_{k}") for k, v in parts.items()], extension.alias("ext"),
    )
    base = weighted_mean([(w, F.col(f"comp_{k}")) for k, w in fv.PRE_RESULT_WEIGHTS.items()])
    gate = F.when(c("adv20_cr") < 2, F.lit(0.6)).otherwise(F.lit(1.0)) * (
        F.when(days < 2, F.lit(0.5)).when(days < 4, F.lit(0.85)).otherwise(F.lit(1.0)))
    scored = F.col("comp_rel_strength").isNotNull()
    stage = (
        F.when(~scored, F.lit("No data"))
        .when(days < 2, F.lit("Too close"))
        .when(F.col("ext") >= 0.5, F.lit("Extended"))
        .when(F.col("rs_z") < 0, F.lit("Weak"))
        .when(F.col("rs_z") > 1.0, F.lit("Building"))
        .when((F.col("accel_z") > 0) | (c("rvol_5d") >= 1.2) | (c("deliv_qty_ratio") >= 1.2), F.lit("Early"))
        .otherwise(F.lit("Neutral"))
    )
    components = F.map_filter(
        F.create_map(*[x for k in parts for x in (F.lit(k), F.round(F.col(f"comp_{k}"), 3))]),
        lambda k, v: v.isNotNull(),
    )
    return second.select(
        *[f"`{n}`" for n in first.columns],
        components.alias("components"),
        F.when(scored, F.round("ext", 2)).alias("extension"),
        F.when(scored, F.round(100 * base * (1 - 0.45 * F.col("ext")) * gate, 1)).alias("score"),
        stage.alias("stage"),
    )


def explain_pre_result(rows: DataFrame, market_name: str = fv.MARKET_INDEX) -> DataFrame:
    """Adds ``reasons`` and ``risks``: the sentences behind a scored row, in a fixed order."""
    c = lambda name: number(field(rows, name))
    text = lambda name: field(rows, name, "string")
    say = F.format_string
    days = field(rows, "trading_days_left", "int")
    sector_based = F.col("rel_base") == "sec"
    bench = F.when(sector_based, text("sector_index")).otherwise(F.lit(market_name))
    r5, r10 = (F.when(sector_based, c(f"rel_sec_{k}d")).otherwise(c(f"rel_mkt_{k}d")) for k in (5, 10))

    when_text = say("Results on %s (%d trading day%s away)", text("result_date").cast("string"), days,
                    F.when(days != 1, F.lit("s")).otherwise(F.lit("")))
    ahead = F.when(days.between(5, 15), F.concat(when_text, F.lit(" — inside the 5–15 session pre-results window"))) \
        .when(days > 15, when_text)
    near = F.when(days < 5, F.concat(when_text, F.lit(" — little time left for a pre-results move")))

    both = r5.isNotNull() & r10.isNotNull()
    p5, p10 = signed_percent(r5), signed_percent(r10)
    leading = (
        F.when(both & (r5 > 0) & (r10 > 0), say("Outperforming %s: %s over 5 sessions, %s over 10", bench, p5, p10))
        .when(both & (r5 > 0), say("Turning up vs %s: %s over 5 sessions after lagging over 10 (%s)", bench, p5, p10)))
    lagging = F.when(both & (r5 <= 0) & (r10 <= 0), say("Lagging %s: %s over 5 sessions, %s over 10", bench, p5, p10))
    unmapped = F.when(~sector_based & c("rel_mkt_5d").isNotNull(),
                      F.lit(f"No sector index mapped — relative strength is vs {market_name} only"))

    pace = say("last 5 sessions %s vs %s the 5 before", signed_percent(c("ret_5d")), signed_percent(c("ret_prev5d")))
    faster = F.when(c("accel") > 0.01, F.concat(F.lit("Momentum accelerating: "), pace))
    slower = F.when(c("accel") < -0.03, F.concat(F.lit("Momentum fading: "), pace))

    rvol, ud = c("rvol_5d"), c("updown_vol_ratio")
    volume = F.concat(say("Volume %.1f× its 50-day average", rvol),
                      F.when(ud > 1.2, say(", heavier on up days (%.1f×)", ud)).otherwise(F.lit("")))
    busy = F.when((rvol >= 1.2) & (rvol <= 4), volume)
    climax = F.when(rvol > 4, F.concat(volume, F.lit(" — climactic, could be exhaustion")))

    dp, db, dq = c("deliv_pct_5d"), c("deliv_pct_base"), c("deliv_qty_ratio")
    share = F.when(dp.isNotNull() & db.isNotNull(), say("; %.0f%% of volume delivered vs %.0f%% before", dp, db)) \
        .otherwise(F.lit(""))
    gathered = F.when(dq >= 1.2, F.concat(say("Delivered shares %.1f× the prior 20 sessions", dq), share))
    drying = F.when((dq < 0.85) & (dp < db - 3),
                    F.concat(say("Delivery drying up: delivered shares %.1f× usual", dq), share))

    n = F.coalesce(field(rows, "hist_events", "long"), F.lit(0).cast("long"))
    mean, hit, gap = c("hist_pre_excess_mean"), c("hist_pre_hit_rate"), c("hist_gap_abs_mean")
    past = say("Past %d results: avg %s vs market in the 10 sessions before, positive %d/%d times",
               n, signed_percent(mean), F.bround(hit * n).cast("long"), n)
    poor = ~is_true((mean > 0.005) & (hit >= 0.5)) & is_true(mean < -0.01)
    past_good, past_bad = F.when((n >= 2) & ~poor, past), F.when((n >= 2) & poor, past)
    gap_text = say("Post-result gap avg %s (typical size %.1f%%)", signed_percent(c("hist_gap_mean")), gap * 100)
    gap_good = F.when((n >= 2) & (gap <= 0.05), gap_text)
    gap_bad = F.when((n >= 2) & (gap > 0.05), F.concat(gap_text, F.lit(" — large binary event risk")))
    no_past = F.when((n < 2) & is_true(field(rows, "enriched", "boolean")),
                     F.lit("Fewer than 2 past results in price history — no pattern to lean on"))

    fs = c("fund_score")
    bits = F.concat_ws(", ", *[
        F.when(c(name).isNotNull(), say(f"{label} %.0f%%", c(name)))
        for name, label in (("Return on capital employed", "ROCE"), ("YOY Quarterly profit growth", "profit YoY"),
                            ("YOY Quarterly sales growth", "sales YoY"))])
    quality = F.concat(say("Fundamentals score %.0f", fs),
                       F.when(bits != "", F.concat(F.lit(" ("), bits, F.lit(")"))).otherwise(F.lit("")))
    fund_good, fund_bad = F.when(fs >= 55, quality), F.when(fs < 55, quality)
    fund_none = F.when(fs.isNull() & (text("fund_source") == "none"),
                       F.lit("No fundamentals on file — add a fundamentals CSV"))

    if "catalyst_top" in rows.columns:
        def sentence(ev: Column) -> Column:
            size = F.when(F.coalesce(ev["order_value_cr"], F.lit(0.0)) != 0, F.concat(
                F.lit(" ₹"), F.format_number(ev["order_value_cr"], 0), F.lit(" cr"),
                F.when(F.coalesce(ev["order_pct_revenue"], F.lit(0.0)) != 0,
                       F.concat(F.lit(" ("), say("%.0f", ev["order_pct_revenue"]), F.lit("% of revenue)")))
                .otherwise(F.lit("")))).otherwise(F.lit(""))
            body = F.when(F.coalesce(ev["text"], F.lit("")) != "", ev["text"]).otherwise(F.coalesce(ev["title"], F.lit("")))
            body = F.trim(F.replace(body, F.concat(F.coalesce(text("company"), F.lit("")),
                                                   F.lit(" has informed the Exchange")), F.lit("")))
            return F.concat(F.lit("Filing: "), ev["event_label"], size, F.lit(" — "), F.substring(body, 1, 100))

        top2 = F.slice(F.coalesce("catalyst_top", F.array().cast(rows.schema["catalyst_top"].dataType)), 1, 2)
        filings_up = F.transform(F.filter(top2, lambda e: e["impact"] > 0), sentence)
        filings_down = F.transform(F.filter(top2, lambda e: ~(e["impact"] > 0)), sentence)
    else:
        filings_up = filings_down = F.array().cast("array<string>")

    z20, rsi, adv, vol = c("z_20d"), c("rsi14"), c("adv20_cr"), c("vol_ann")
    stretched = F.when(z20 > 1.5, say("Already up %s in 20 sessions (%.1fσ) — may be priced in",
                                      signed_percent(c("ret_20d")), z20))
    hot = F.when(rsi >= 72, say("RSI %.0f: overbought", rsi))
    thin = F.when(adv < 5, say("Thin liquidity: ₹%.1f cr/day traded", adv))
    wild = F.when(vol > 0.6, say("High volatility: %.0f%% annualised", vol * 100))

    known = F.col("stage") != "No data"
    empty = F.array().cast("array<string>")
    reasons = F.concat(drop_nulls([ahead, leading, faster, busy, gathered, past_good, gap_good, fund_good]), filings_up)
    risks = F.concat(
        drop_nulls([near, lagging, unmapped, slower, climax, drying, past_bad, gap_bad, no_past, fund_bad, fund_none]),
        filings_down, drop_nulls([stretched, hot, thin, wild]))
    return rows.select(
        "*",
        F.when(known, reasons).otherwise(empty).alias("reasons"),
        F.when(known, risks).otherwise(F.array(F.lit("not enough price history to score"))).alias("risks"),
    )


# ---- fundamentals ---------------------------------------------------------------------------------

def add_fundamental_score(df: DataFrame, include_liquidity: bool = True, name: str = "fund_score") -> DataFrame:
    """Adds a score of 0..100 from growth, quality, balance, value, foreign holding and liquidity.

    Null without growth, quality and value. Works in layers of columns, so that each part is computed once.
    """
    c = lambda field_name: number(field(df, field_name))
    facts = {
        "pg": c("YOY Quarterly profit growth"), "sg": c("YOY Quarterly sales growth"),
        "roce": c("Return on capital employed"), "opm": c("OPM"), "cfo": c("CFO by PAT"), "de": c("Debt to equity"),
        "pe": c("Price to Earning"), "peg": c("PEG Ratio"), "fii": c("Change in FII holding"),
        "adv": c("adv20_cr") if include_liquidity else F.lit(None).cast("double"),
    }
    one = df.select("*", *[v.alias(f"_f_{k}") for k, v in facts.items()])
    f = lambda k: F.col(f"_f_{k}")
    clipped = {
        "pg": clip_range(F.log1p(clamp(f("pg"), -90, 300) / 100), 0, 1.4), "sg": clip_range(f("sg"), 0, 60),
        "roce": clip_range(f("roce"), 10, 35), "opm": clip_range(f("opm"), 8, 30), "cfo": clip_range(f("cfo"), 0, 1),
        "balance": clip_range(1.5 - f("de"), 0, 1.5),
        "pe": F.when(f("pe") <= 0, F.lit(0.0)).otherwise(clip_range(60 - f("pe"), 0, 50)),
        "peg": F.when(f("peg") > 0, clip_range(2.5 - f("peg"), 0, 2)), "fii": clip_range(f("fii"), 0, 2),
        "liq": F.when(f("adv").isNotNull(), clip_range(F.log10(F.greatest(f("adv"), F.lit(0.1))), .3, 2)),
    }
    two = one.select(*[f"`{n}`" for n in df.columns], *[v.alias(f"_c_{k}") for k, v in clipped.items()])
    p = lambda k: F.col(f"_c_{k}")
    groups = {
        "growth": weighted_mean([(.5, p("pg")), (.5, p("sg"))]),
        "quality": weighted_mean([(.4, p("roce")), (.3, p("opm")), (.3, p("cfo"))]),
        "balance": p("balance"), "value": weighted_mean([(.5, p("pe")), (.5, p("peg"))]), "fii": p("fii"), "liq": p("liq"),
    }
    three = two.select(*[f"`{n}`" for n in df.columns], *[v.alias(f"_g_{k}") for k, v in groups.items()])
    g = lambda k: F.col(f"_g_{k}")
    total = weighted_mean([(.30, g("growth")), (.25, g("quality")), (.10, g("balance")), (.15, g("value")), (.10, g("fii")),
                           (.10, g("liq"))])
    score = F.when(F.coalesce(g("growth"), g("quality"), g("value")).isNotNull(), 100 * total)
    return three.select(*[f"`{n}`" for n in df.columns], score.alias(name))


def technical_score(r60: Column, above_50dma: Column) -> Column:
    trend = weighted_mean([
        (.4, above_50dma.cast("double")),
        (.3, clip_range(r60, -.1, .3)),
        (.3, 1 - clip_range(r60, .4, .8))])
    return F.when(r60.isNotNull(), 100 * trend)


def result_screen_scores(rows: DataFrame) -> DataFrame:
    """Adds fund_score, tech_score and composite to result-screen rows."""
    first = add_fundamental_score(rows).withColumn(
        "tech_score", technical_score(number(field(rows, "ret_60d")), field(rows, "above_50dma", "boolean")))
    fund, tech = F.col("fund_score"), F.col("tech_score")
    late = F.when(F.col("trading_days_left") < 5, 15).otherwise(0)
    thin = F.when(number(field(rows, "adv20_cr")) < 10, 10).otherwise(0)
    mixed = F.when(tech.isNotNull(), .7 * fund + .3 * tech).otherwise(.85 * fund)
    return first.withColumn("composite", mixed - late - thin)


def result_screen_flags(rows: DataFrame) -> Column:
    """Warnings joined by '; ' in a fixed order."""
    c = lambda name: number(field(rows, name))
    source = F.col("fundamentals_source")
    return F.concat_ws(
        "; ",
        F.when(source == "none", "no fundamentals"),
        F.when(source == "provider", "partial fundamentals (no ROCE/FII/CFO)"),
        F.when(c("YOY Quarterly profit growth") > 500, "profit growth >500%: low base / one-off likely"),
        F.when(F.col("trading_days_left") < 5, "<5 trading days to result"),
        F.when(c("adv20_cr") < 10, "illiquid (<₹10cr/day)"),
        F.when((c("pct_of_52w_high") > .97) & (F.coalesce(c("ret_60d"), F.lit(0.0)) > .4),
               "extended: near 52w high after >40% run"),
        F.when((c("history_days") > 0) & (c("history_days") < 120), "short price history"),
    )


def provider_quality_score(df: DataFrame) -> Column:
    """0..100 from a provider's ratios; debt to equity comes in percent."""
    c = lambda name: number(field(df, name))
    none = F.lit(0.0)
    de, pe = c("debt_equity") / 100.0, c("pe")
    points = (
        F.lit(50.0)
        + F.coalesce(F.least(F.lit(20.0), c("roe") * 80), none)
        + F.when(de.isNull(), none).when(de < 0.5, 15.0).when(de < 1, 8.0).when(de < 2, 2.0).when(de < 3, -5.0)
        .otherwise(-15.0)
        + F.coalesce(F.least(F.lit(15.0), c("net_margin") * 50), none)
        + F.coalesce(F.least(F.lit(10.0), c("rev_growth") * 40), none)
        + F.when(pe.isNull(), none).when(pe < 0, -10.0).when(pe > 80, -10.0).when(pe > 50, -5.0)
        .when(pe.between(12, 30), 5.0).otherwise(none)
    )
    return F.round(clamp(points, 0, 100), 1)


# ---- composite signal ------------------------------------------------------------------------------

def signal_inputs(bars: DataFrame, periods: tuple[int, ...] = (14, 21, 50, 100, 200)) -> DataFrame:
    """Newest indicator values per symbol, folded over its ordered bars (one row per session)."""
    grouped = bars.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("date", "h", "l", "c", "v"))).alias("b"))
    arrays = grouped.select("symbol", "b", F.transform("b", lambda x: x["c"]).alias("closes"))
    n = F.size("b")
    tail = lambda field_name, k: F.transform(
        F.slice("b", F.greatest(n - k + 1, F.lit(1)), F.lit(k)), lambda x: x[field_name])
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    mean_of = lambda field_name, k: F.when(n >= k, total(tail(field_name, k)) / k)
    mid = mean_of("c", 20)
    dev = F.sqrt(F.aggregate(tail("c", 20), F.lit(0.0), lambda a, x: a + (x - total(tail("c", 20)) / 20) ** 2) / 20)
    folded = arrays.select(
        "symbol",
        n.cast("long").alias("bars"),
        F.element_at("closes", -1).alias("price"),
        F.element_at("b", -1)["v"].alias("volume"),
        (total(tail("v", 20)) / 20).alias("avg20"),
        *[ema_latest(F.col("closes"), p).alias(f"ema{p}") for p in periods],
        *[mean_of("c", p).alias(f"sma{p}") for p in (14, 50, 100, 200)],
        rsi_wilder(F.col("closes")).alias("rsi"),
        macd_latest(F.col("closes")).alias("macd"),
        trend_latest(F.col("b")).alias("band"),
        adx_latest(F.col("b")).alias("adx"),
        mid.alias("bb_mid"), F.when(n >= 20, dev).alias("bb_dev"),
        F.array_max(tail("h", 252)).alias("week52High"),
        F.array_min(tail("l", 252)).alias("week52Low"),
    )
    # one row per symbol already: this keeps later filters on an indicator from repeating its fold
    once = folded.groupBy("symbol").agg(*[F.first(c).alias(c) for c in folded.columns if c != "symbol"])
    return once.select(
        "*", F.col("macd.line").alias("macd_line"), F.col("macd.signal").alias("macd_signal"),
        F.col("band.trend").alias("supertrend"),
        (F.col("bb_mid") + 2 * F.col("bb_dev")).alias("bb_up"), (F.col("bb_mid") - 2 * F.col("bb_dev")).alias("bb_low"),
    ).drop("macd", "band", "bb_dev")


def composite_signal(inputs: DataFrame, min_bars: int = 50) -> DataFrame:
    """Adds the -100..100 score, its label, the breakdown and a warning to ``signal_inputs`` rows.

    Optional columns: ``nlp_score`` (-1..1) and ``fundamental_score`` (0..100). Components without data
    drop out and the other weights are renormalised.
    """
    nlp, fund = field(inputs, "nlp_score"), field(inputs, "fundamental_score")
    st = F.col("supertrend").cast("double")
    raw = ratio(F.col("ema21") - F.col("ema50"), F.col("ema50"))
    hist = F.col("macd_line") - F.col("macd_signal")
    vol_ratio = F.when(F.col("avg20") > 0, F.col("volume") / F.col("avg20"))
    scores = {
        "trend": clamp(raw * 25, -1, 1),
        "momentum": F.when(F.col("price") > 0, clamp(hist / (F.col("price") * 0.004), -1, 1)),
        "supertrend": st,
        "volume": F.signum(st) * F.abs(clamp((vol_ratio - 1) * 2, -1, 1)),
        "sentiment": clamp(nlp, -1, 1),
        "fundamental": clamp((fund - 50) / 50, -1, 1),
    }
    say = F.format_string
    reasons = {
        "trend": say("EMA21 (%.0f) is %s EMA50 (%.0f) by %.2f%%", F.col("ema21"),
                     F.when(raw > 0, F.lit("above")).otherwise(F.lit("below")), F.col("ema50"), F.abs(raw * 100)),
        "momentum": say("MACD histogram is %s (%.2f)",
                        F.when(hist > 0, F.lit("bullish")).otherwise(F.lit("bearish")), hist),
        "supertrend": F.when(st > 0, F.lit("Supertrend is bullish (price above band)"))
        .otherwise(F.lit("Supertrend is bearish (price below band)")),
        "volume": say("Volume is %.1f× the 20-day average (%s trend)", vol_ratio,
                      F.when(st > 0, F.lit("confirms")).otherwise(F.lit("contrarian to"))),
        "sentiment": say("News sentiment score: %.2f (7-day average)", scores["sentiment"]),
        "fundamental": say("Fundamental quality score: %.0f/100", fund),
    }
    enough = F.col("bars") >= min_bars
    first = inputs.select("*", *[F.when(enough, v).alias(f"part_{k}") for k, v in scores.items()])
    weights = fv.SIGNAL_WEIGHTS
    have = [F.col(f"part_{k}").isNotNull() for k in weights]
    total = sum((F.when(h, F.lit(w)).otherwise(F.lit(0.0)) for h, w in zip(have, weights.values())), F.lit(0.0))
    contribution = {
        k: F.when(F.col(f"part_{k}").isNotNull(), w / F.when(total != 0, total) * F.col(f"part_{k}") * 100)
        for k, w in weights.items()
    }
    composite = sum((F.coalesce(v, F.lit(0.0)) for v in contribution.values()), F.lit(0.0))
    entries = F.filter(F.array(*[
        F.when(F.col(f"part_{k}").isNotNull(), F.struct(
            F.lit(k).alias("component"), half_up(F.col(f"part_{k}") * 100).alias("score"),
            half_up(contribution[k]).alias("contribution"), half_up(w / total * 100).alias("weight"),
            reasons[k].alias("reason")))
        for k, w in weights.items()]), lambda x: x.isNotNull())
    missing = F.concat_ws(", ", *[F.when(~h, F.lit(k)) for h, k in zip(have, weights)])
    second = first.select(
        "*", F.when(enough & (total > 0), half_up(composite)).alias("signal_score"), entries.alias("breakdown"),
        F.when(~enough, F.lit("Insufficient price history (need ≥ 50 bars)"))
        .when(total == 0, F.lit("No components available"))
        .when(missing != "", F.concat(F.lit("Based on technicals only (missing: "), missing, F.lit(")")))
        .alias("signal_warning"),
    )
    t = fv.SIGNAL_THRESHOLDS
    s = F.col("signal_score")
    label = (
        F.when(s >= t["STRONG BUY"], "STRONG BUY").when(s >= t["BUY"], "BUY")
        .when(s <= t["STRONG SELL"], "STRONG SELL").when(s <= t["SELL"], "SELL").otherwise("NEUTRAL"))
    return second.withColumn("signal", label)
