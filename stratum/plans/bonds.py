"""Corporate bonds: the universe of issues, and the cleaning of reported trades."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import inner_name, null_safe, table_function
from ..shared import materialize

# The conditions on an issue, of plain senior fixed or zero coupon US corporate bonds.
ISSUES = """
security_level = 'SEN' AND (slob = 'N' OR slob IS NULL) AND security_pledge IS NULL AND (asset_backed = 'N' OR asset_backed IS NULL)
AND (defeased = 'N' OR defeased IS NULL) AND defeased_date IS NULL AND bond_type IN ('CDEB', 'CMTN', 'CMTZ', 'CZ', 'USBN')
AND (pay_in_kind <> 'Y' OR pay_in_kind IS NULL) AND pay_in_kind_exp_date IS NULL AND (yankee = 'N' OR yankee IS NULL)
AND (canadian = 'N' OR canadian IS NULL) AND foreign_currency = 'N' AND coupon_type IN ('F', 'Z') AND fix_frequency IS NULL
AND coupon_change_indicator = 'N' AND interest_frequency IN ('0', '1', '2', '4', '12') AND rule_144a = 'N'
AND (private_placement = 'N' OR private_placement IS NULL) AND defaulted = 'N' AND filing_date IS NULL AND settlement IS NULL
AND convertible = 'N' AND exchange IS NULL AND (putable = 'N' OR putable IS NULL) AND (unit_deal = 'N' OR unit_deal IS NULL)
AND (exchangeable = 'N' OR exchangeable IS NULL) AND perpetual = 'N' AND (preferred_security = 'N' OR preferred_security IS NULL)
"""
ISSUE_COLUMNS = "complete_cusip maturity offering_amt offering_date dated_date interest_frequency coupon last_interest_date issue_id issuer_id".split()
#: Reports from this day on follow the newer rules.
NEW_RULES = "2012-02-06"
MESSAGE = "cusip_id msg_seq_nb entrd_vol_qt rptd_pr rpt_side_cd cntra_mp_id trd_exctn_dt trd_exctn_tm".split()
TRADE = "cusip_id trd_exctn_dt entrd_vol_qt rptd_pr rpt_side_cd cntra_mp_id".split()
CLEAN = "cusip_id trd_exctn_dt trd_exctn_tm rptd_pr entrd_vol_qt yld_pt rpt_side_cd cntra_mp_id".split()


def check_identifiers(columns: list[str] | None) -> list[str]:
    """Extra columns by name; only plain lower-case identifiers."""
    bad = [c for c in columns or [] if not isinstance(c, str) or not re.fullmatch(r"[a-z_][a-z0-9_]*", c)]
    if bad:
        raise ValueError(f"Not column names: {bad}.")
    return list(columns or [])


@table_function
def fisd_bonds(issues: DataFrame, issuers: DataFrame, additional_columns: list[str] | None = None, filtered: bool = True) -> DataFrame:
    """Issues of the universe by issuers in the USA, with the issuer's SIC code. filtered=False: issues already are."""
    more = [c for c in check_identifiers(additional_columns) if c not in ISSUE_COLUMNS]
    kept = (issues.where(ISSUES) if filtered else issues).select(*ISSUE_COLUMNS, *more)
    home = issuers.where("country_domicile = 'USA'").select("issuer_id", "sic_code")
    return kept.join(home, "issuer_id").drop("issuer_id")


@table_function
def trades_of(trades: DataFrame, cusips: list[str] | None = None) -> DataFrame:
    """Trades of some bonds by their 9-character CUSIPs, or of all; a long list is joined, a short one becomes a filter."""
    if cusips is None:
        return trades
    if not all(isinstance(c, str) and len(c) == 9 for c in cusips):
        raise ValueError("A CUSIP is a string of 9 characters.")
    if len(cusips) <= 1000:
        return trades.where(F.col("cusip_id").isin(*cusips)) if cusips else trades.limit(0)
    wanted = trades.sparkSession.createDataFrame([(c,) for c in set(cusips)], "cusip_id string")
    return trades.join(wanted, "cusip_id", "left_semi")


def _without(trades: DataFrame, gone: DataFrame, keys: list[str], only: str | None = None) -> DataFrame:
    """trades without those that a row of gone equals in all keys, NULLs too; only: the others stay anyhow."""
    on = null_safe(trades, gone, keys)
    if only:
        on &= F.coalesce(F.expr(only), F.lit(False))
    return trades.join(gone, on, "left_anti")


def _match(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    """Joins left to right where each key of left equals the column of right it maps to, NULLs too; right's keys go."""
    names = {theirs: inner_name(theirs) for theirs in keys.values()}
    other = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))
    on = F.lit(True)
    for ours, theirs in keys.items():
        on &= F.col(ours).eqNullSafe(F.col(names[theirs]))
    return left.join(other, on, how).drop(*names.values())


_DAY = {c: c for c in ("cusip_id", "trd_exctn_dt")}


def _jumps(alone: DataFrame) -> DataFrame:
    """alone: numbers with one number _up before them, _far and _times apart; the same with the last _up that is none of them.

    Each round doubles how far a number looks, so a chain takes as many rounds as its length has binary digits. Numbers that
    run in a circle have no such _up and are left out.
    """
    jumps = materialize(alone, "corrections-jumps")
    up = _DAY | {"_up": "_number"}
    for _ in range(jumps.count().bit_length() + 1):
        ahead = jumps.select(*_DAY, "_number", F.col("_up").alias("_up2"), F.col("_far").alias("_far2"), F.col("_times").alias("_times2"))
        both = _match(jumps, ahead, up, "left").withColumn("_on", F.col("_far2").isNotNull())
        both = both.select(*_DAY, "_number", F.when(F.col("_on"), F.col("_up2")).otherwise(F.col("_up")).alias("_up"), (F.col("_far") + F.coalesce("_far2", F.lit(0))).alias("_far"), (F.col("_times") * F.coalesce("_times2", F.lit(1))).alias("_times"), "_on")
        both = materialize(both, "corrections-jumps")
        jumps = both.drop("_on")
        if both.where("_on").isEmpty():
            return jumps
    return _match(jumps, jumps.select(*_DAY, "_number"), up, "left_anti")


def _reached(steps: DataFrame, carried: DataFrame, corrected: DataFrame) -> DataFrame:
    """The corrected numbers that trades lead to: in which round first, and with how many copies of each correction.

    A number that a trade carries is reached in round 0, any other in the round behind the first of the numbers that
    corrections lead from to it. Stretches of numbers with one number before them are jumped over (`_jumps`); only
    where several lead to one are rounds repeated, until nothing changes.
    """
    number = _DAY | {"_number": "_number"}
    arcs = steps.select(*_DAY, F.col("_number").alias("_up"), F.col("_next").alias("_number"), F.lit(1).alias("_far"), F.col("_n").alias("_times"))
    arcs = materialize(_match(_match(arcs, corrected, number, "left_semi"), carried, number, "left_anti"), "corrections-arcs")
    before = arcs.groupBy(*_DAY, "_number").agg(F.count(F.lit(1)).alias("_k"))
    alone = _match(arcs, before.where("_k = 1").drop("_k"), number, "left_semi")
    jumps = _jumps(alone)
    # What leads to numbers with several before them, from the nearest number that is no jump.
    several = _match(arcs, before.where("_k > 1").drop("_k"), number, "left_semi")
    over = jumps.select(*_DAY, "_number", F.col("_up").alias("_up2"), F.col("_far").alias("_far2"), F.col("_times").alias("_times2"))
    far = _match(several, over, _DAY | {"_up": "_number"}, "inner").select(*_DAY, "_number", F.col("_up2").alias("_up"), (F.col("_far") + F.col("_far2")).alias("_far"), (F.col("_times") * F.col("_times2")).alias("_times"))
    near = _match(several, alone.select(*number), _DAY | {"_up": "_number"}, "left_anti")
    several = materialize(near.unionByName(far), "corrections-arcs")

    def follow(arcs: DataFrame, values: DataFrame) -> DataFrame:
        at = values.select(*_DAY, F.col("_number"), F.col("_round"), F.col("_copies"))
        found = _match(arcs, at, _DAY | {"_up": "_number"}, "inner")
        return found.select(*number, (F.col("_round") + F.col("_far")).alias("_round"), (F.col("_copies") * F.col("_times")).alias("_copies"))

    values, state = carried, None
    while not several.isEmpty():
        found = follow(several, values).groupBy(*number, "_round").agg(F.sum("_copies").alias("_copies"))
        found = found.groupBy(*number).agg(F.min(F.struct("_round", "_copies")).alias("_first"))
        found = materialize(found.select(*number, "_first.*"), "corrected")
        last, state = state, tuple(found.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*found.columns).cast("decimal(38,0)"))).first())
        values = carried.unionByName(found.select(*carried.columns))
        if state == last:
            break
    return materialize(values.unionByName(follow(jumps, values).select(*values.columns)), "corrected")


def _replaced(trades: DataFrame, corrections: DataFrame, copies: str) -> tuple[DataFrame, bool]:
    """trades after their corrections: a correction takes the place of the trades of its bond and day that carry the number
    it corrects, once for each, and may itself be corrected by one that found nothing before.

    The column copies tells how often a row stands there, so that rows do not grow with corrections times trades of a
    number; with it comes whether there are corrections at all. A number is reached in round 0 if a trade carries it, later if a correction does that corrects a number of the
    round before; the round that reaches a number first decides. What is followed are numbers with their copies, not trades,
    by joins on bond, day and number; a chain takes rounds by the logarithm of its length.
    """
    number = _DAY | {"_number": "_number"}
    once = trades.withColumn(copies, F.lit(1).cast("bigint"))
    steps = corrections.groupBy(*_DAY, F.col("orig_msg_seq_nb").alias("_number"), F.col("msg_seq_nb").alias("_next"))
    steps = materialize(steps.agg(F.count(F.lit(1)).alias("_n")), "corrections")
    if steps.isEmpty():
        return once, False
    corrected = steps.select(*number).distinct()
    carried = trades.groupBy(*_DAY, F.col("msg_seq_nb").alias("_number")).agg(F.count(F.lit(1)).alias("_copies"))
    carried = materialize(_match(carried, corrected, number, "left_semi").withColumn("_round", F.lit(0)), "carried")
    reached = _reached(steps, carried, corrected)
    kept = _match(once, corrected, _DAY | {"msg_seq_nb": "_number"}, "left_anti")
    placed = _match(corrections, reached, _DAY | {"orig_msg_seq_nb": "_number"}, "inner").withColumn("_round", F.col("_round") + 1)
    placed = _match(placed, reached.drop("_copies"), _DAY | {"msg_seq_nb": "_number", "_round": "_round"}, "left_anti")
    return kept.unionByName(placed.select(*trades.columns, F.col("_copies").alias(copies))), True


#: Copies of a row that one task makes in one go.
BLOCK = 1024


def _repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its column copies says, which goes. Copies are made in blocks that are dealt to all tasks; no
    array holds more than BLOCK of them, or the numbers of a row's blocks."""
    block, many = inner_name("block"), F.col(copies)
    names = [c for c in rows.columns if c != copies]
    blocks = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((many - 1) / BLOCK))))
    blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(BLOCK).cast("bigint"), many - F.col(block) * BLOCK)))
    return blocks.withColumn(inner_name("copy"), one).select(*(f"`{c}`" for c in names))


def _corrected(trades: DataFrame, corrections: DataFrame) -> DataFrame:
    """trades after their corrections (`_replaced`), each copy a row."""
    copies = inner_name("copies")
    return _repeated(_replaced(trades, corrections, copies)[0], copies)


def _less_reversed(trades: DataFrame, reversals: DataFrame, copies: str) -> DataFrame:
    """trades without the first of each TRADE, as many as reversals has of it; only what has reversals is sorted."""
    gone, upto = inner_name("gone"), inner_name("upto")
    counts = reversals.groupBy(*TRADE).agg(F.sum(copies).alias(gone))
    both = _match(trades, counts, {c: c for c in TRADE}, "left")
    time = ["cusip_id", "trd_exctn_dt", "trd_exctn_tm", "trd_rpt_dt", "trd_rpt_tm"]
    order = Window.partitionBy(*TRADE).orderBy(*time, "msg_seq_nb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = both.where(F.col(gone).isNotNull()).withColumn(upto, F.sum(copies).over(order))
    some = some.withColumn(copies, F.least(F.col(copies), F.col(upto) - F.col(gone))).where(F.col(copies) > 0)
    return both.where(F.col(gone).isNull()).select(*trades.columns).unionByName(some.select(*trades.columns))


@table_function
def process_trace_data(trace_all: DataFrame, strict_status: bool = False) -> DataFrame:
    """Reported trades without cancelled, corrected, reversed and doubly reported ones, and with ordinary terms only.

    Before NEW_RULES a correction replaces what it corrects, and messages of every status count as trades;
    strict_status=True takes those with status T only.
    """
    data = trace_all.withColumn("trd_rpt_dt", F.col("trd_rpt_dt").cast("date"))
    new, old = data.where(F.col("trd_rpt_dt") >= NEW_RULES), data.where(F.col("trd_rpt_dt") < NEW_RULES)
    status = lambda df, *codes: df.where(F.col("trc_st").isin(*codes))
    cancelled = lambda df: df.drop("msg_seq_nb").withColumnRenamed("orig_msg_seq_nb", "msg_seq_nb").select(*MESSAGE)
    after = _without(status(new, "T", "R"), status(new, "X", "C").select(*MESSAGE), MESSAGE)
    after = _without(after, cancelled(status(new, "Y")), MESSAGE)

    before = status(old, "T") if strict_status else old
    before = _without(before, cancelled(status(old, "C")), MESSAGE)
    copies = inner_name("copies")
    before, several = _replaced(before, status(old, "W"), copies)
    others = before.where("asof_cd IS NULL OR asof_cd NOT IN ('R', 'X', 'D')")
    before = _less_reversed(others, before.where("asof_cd = 'R'"), copies)

    clean = before.unionByName(after.withColumn(copies, F.lit(1).cast("bigint")))
    clean = clean.where("cntra_mp_id = 'C' OR cntra_mp_id = 'D' AND rpt_side_cd IN ('S', 'B')")
    pair = ["cusip_id", "trd_exctn_dt", "entrd_vol_qt", "rptd_pr"]
    sells = clean.where("cntra_mp_id = 'D' AND rpt_side_cd = 'S'").select(*pair).distinct()
    clean = _without(clean, sells, pair, only="cntra_mp_id = 'D' AND rpt_side_cd = 'B'")
    days = F.col("days_to_sttl_ct").cast("string").try_cast("double")
    apart = F.datediff("stlmnt_dt", "trd_exctn_dt")
    kept = clean.where((days.isNull() | (days <= 7)) & (apart.isNull() | (apart <= 7)) & (F.col("wis_fl") == "N"))
    kept = kept.where("(spcl_trd_fl IS NULL OR spcl_trd_fl = '') AND (asof_cd IS NULL OR asof_cd = '')")
    return _repeated(kept.select(*CLEAN, copies), copies) if several else kept.select(*CLEAN)
