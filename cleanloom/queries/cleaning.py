"""Queries that clean, fill, repair, scale, bin and encode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.operators import bins, cleanse, encode, impute, outliers, scale
from cleanloom.operators.build import build_data as build
from cleanloom.plans.grouping import Grouping
from cleanloom.queries.inputs import (
    GAPPY_EVENT_SQL,
    GAPPY_SQL,
    LINE_ID,
    LINE_SQL,
    LINE_VALUES,
    gappy_events,
    gappy_lines,
)
from cleanloom.queries.registry import query, rounded, sql_rounded, table
from cleanloom.sources.files import canonical_prices, letters_only

SUPPLIER = ["l_suppkey"]
IDS = "l_suppkey, l_orderkey, l_linenumber, l_partkey"


def is_train() -> Column:
    return F.col("is_train")


# -- column cleaning ------------------------------------------------------------------------------------------------


@query(
    "text_money",
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS balance, c_mktsegment
    FROM customer""",
)
def text_money(spark, folder) -> DataFrame:
    """Balances written as ``$1,234.50``, some of them not a number."""
    money = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    text = F.when(F.col("c_custkey") % 11 == 0, "$n/a").otherwise(money)
    rows = table(spark, folder, "customer").select("c_custkey", text.alias("balance"), "c_mktsegment")
    return cleanse.money_text_to_double(rows)


@query("drop_text_columns", "SELECT p_name, p_partkey, p_size, p_retailprice FROM part")
def drop_text_columns(spark, folder) -> DataFrame:
    rows = table(spark, folder, "part").select("p_name", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return cleanse.drop_text_after_first(rows)


@query(
    "parse_dates",
    "SELECT o_orderkey, CAST(epoch_us(o_orderdate) // 86400000000 AS INTEGER) AS day FROM orders",
)
def parse_dates(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("day"))
    return cleanse.parse_month_first_date(rows, "day").withColumn("day", F.unix_date("day"))


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(epoch_us(make_date(y, m, d)::TIMESTAMP) // 86400000000 AS INTEGER) AS day FROM (
      SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
             CAST(1 + (o_orderkey * 7) % 31 AS INTEGER) AS d FROM orders)
    WHERE d <= day(last_day(make_date(y, m, 1)))""",
)
def date_parts(spark, folder) -> DataFrame:
    """Dates from parts, some of which do not exist."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("Year"),
        F.month("o_orderdate").alias("Month"),
        (1 + (F.col("o_orderkey") * 7) % 31).cast("int").alias("Day"),
    )
    out = cleanse.date_from_parts(rows, "Year", "Month", "Day")
    return out.select("o_orderkey", F.unix_date("Date").alias("day"))


@query(
    "sentinel_to_null",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS AvgTemperature,
      CASE WHEN o_orderkey % 17 = 0 THEN -99.0 ELSE o_totalprice END AS other FROM orders""",
)
def sentinel_to_null(spark, folder) -> DataFrame:
    def marked(n: int):
        return F.when(F.col("o_orderkey") % n == 0, F.lit(-99.0)).otherwise(F.col("o_totalprice"))

    rows = table(spark, folder, "orders").select("o_orderkey", marked(13).alias("AvgTemperature"), marked(17).alias("other"))
    return cleanse.sentinel_to_null(rows)


@query(
    "missing_flags",
    f"""SELECT is_train, bool_or(qty IS NULL OR price IS NULL OR disc IS NULL OR tax IS NULL) AS has_missing
    FROM ({GAPPY_SQL}) GROUP BY is_train""",
)
def missing_flags(spark, folder) -> DataFrame:
    return cleanse.missing_flags(gappy_lines(spark, folder), LINE_VALUES, ["is_train"])


@query(
    "missing_profile",
    " UNION ALL ".join(
        f"""SELECT l_suppkey, '{c}' AS "column", {sql_rounded(f"100.0::DOUBLE * sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*)")}
        AS missing_pct FROM ({GAPPY_SQL}) GROUP BY l_suppkey"""
        for c in LINE_VALUES
    ),
)
def missing_profile(spark, folder) -> DataFrame:
    out = cleanse.missing_profile(gappy_lines(spark, folder), LINE_VALUES, SUPPLIER)
    return out.withColumn("missing_pct", rounded("missing_pct"))


@query(
    "drop_sparse_columns",
    f"SELECT {IDS}, is_train, price, l_returnflag, tax FROM ({GAPPY_SQL}) WHERE price IS NOT NULL",
)
def drop_sparse_columns(spark, folder) -> DataFrame:
    """One column is mostly missing, one text column has a value per row; both go, as do rows without target."""
    rows = gappy_lines(spark, folder).select(
        "l_suppkey", *LINE_ID, "is_train", "price", "l_returnflag", "tax",
        F.when(F.col("l_orderkey") % 3 == 0, F.col("qty")).alias("mostly_missing"),
        F.concat_ws("-", *LINE_ID).alias("row_name"),
    )
    return cleanse.drop_sparse_columns(rows, "price")


@query("drop_incomplete", f"SELECT {IDS}, l_returnflag, is_train FROM ({LINE_SQL})")
def drop_incomplete(spark, folder) -> DataFrame:
    return cleanse.drop_incomplete_columns(gappy_lines(spark, folder).drop("l_shipdate"))


@query("drop_unseen_columns", f"SELECT {IDS}, is_train, qty FROM ({GAPPY_SQL})")
def drop_unseen_columns(spark, folder) -> DataFrame:
    """A column with values outside the training rows only is dropped."""
    rows = gappy_lines(spark, folder).select(
        "l_suppkey", *LINE_ID, "is_train", "qty", F.when(~is_train(), F.col("price")).alias("test_only")
    )
    return cleanse.drop_unseen_columns(rows, ["qty", "test_only"], is_train())


@query("drop_wide_categories", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_wide_categories(spark, folder) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return cleanse.drop_wide_categories(rows, limit=100)


@query(
    "listing_letters",
    "SELECT DISTINCT p_word FROM (SELECT unnest(string_split(p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR), ' ')) AS p_word FROM part)"
    " WHERE regexp_full_match(p_word, '[A-Za-z]+')",
)
def listing_letters(spark, folder) -> DataFrame:
    """Words of part names and brands that consist of letters only."""
    words = F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")), " "))
    return letters_only(table(spark, folder, "part").select(words.alias("p_word")).distinct(), "p_word")


@query(
    "canonical_columns",
    f"""SELECT CAST(epoch_us(l_shipdate) // 86400000000 AS INTEGER) AS "Date", qty AS "Open", price AS "High", disc AS "Low",
      tax AS "Close", qty AS "Adj Close", price AS "Volume" FROM ({GAPPY_SQL})
    WHERE qty IS NOT NULL OR price IS NOT NULL OR disc IS NOT NULL OR tax IS NOT NULL""",
)
def canonical_columns(spark, folder) -> DataFrame:
    names = ["l_shipdate", "qty", "price", "disc", "tax", "qty", "price"]
    return canonical_prices(gappy_lines(spark, folder), names).withColumn("Date", F.unix_date(F.col("Date").cast("date")))


# -- filling --------------------------------------------------------------------------------------------------------

OVER_SUPPLIER = "OVER (PARTITION BY l_suppkey)"


def _mode_sql(column: str, rows: str) -> str:
    return f"""SELECT l_suppkey, {column} AS m FROM (
      SELECT l_suppkey, {column}, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, {column}) AS rn
      FROM ({rows}) WHERE is_train AND {column} IS NOT NULL GROUP BY l_suppkey, {column}) WHERE rn = 1"""


def _fill_sql(expression: str) -> str:
    cells = ", ".join(
        sql_rounded(f"coalesce({c}, {expression.format(c=c)} FILTER (WHERE is_train) {OVER_SUPPLIER})") + f" AS {c}"
        for c in LINE_VALUES
    )
    return f"SELECT {IDS}, {cells} FROM ({GAPPY_SQL})"


def _filled(spark, folder, method: str) -> DataFrame:
    out = impute.impute(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, method, is_train())
    return out.select("l_suppkey", *LINE_ID, *[rounded(c).alias(c) for c in LINE_VALUES])


@query("impute_mean", _fill_sql("avg({c})"))
def impute_mean(spark, folder) -> DataFrame:
    return _filled(spark, folder, "mean")


@query("impute_median", _fill_sql("quantile_cont({c}, 0.5)"))
def impute_median(spark, folder) -> DataFrame:
    return _filled(spark, folder, "median")


@query(
    "impute_mode",
    f"WITH g AS ({GAPPY_SQL}) SELECT "
    + ", ".join(f"g.{i.strip()}" for i in IDS.split(","))
    + ", "
    + ", ".join(f"coalesce(g.{c}, m_{c}.m) AS {c}" for c in LINE_VALUES)
    + " FROM g "
    + " ".join(f"LEFT JOIN ({_mode_sql(c, 'SELECT * FROM g')}) m_{c} ON m_{c}.l_suppkey = g.l_suppkey" for c in LINE_VALUES),
)
def impute_mode(spark, folder) -> DataFrame:
    out = impute.impute(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, "mode", is_train())
    return out.select("l_suppkey", *LINE_ID, *LINE_VALUES)


@query(
    "impute_events_mean",
    f"""SELECT event_id, user_id, {sql_rounded("coalesce(amount, avg(amount) OVER (PARTITION BY user_id))")} AS amount
    FROM ({GAPPY_EVENT_SQL})""",
)
def impute_events_mean(spark, folder) -> DataFrame:
    out = impute.impute(gappy_events(spark, folder), ["user_id"], ["amount"], "mean")
    return out.select("event_id", "user_id", rounded("amount").alias("amount"))


def _gappy_customers(spark, folder) -> DataFrame:
    rows = table(spark, folder, "customer")
    return rows.select(
        "c_custkey",
        "c_nationkey",
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 7 != 0, F.floor(F.col("c_acctbal") / 100).cast("double")).alias("balance"),
    )


GAPPY_CUSTOMER_SQL = """SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 7 <> 0 THEN floor(c_acctbal / 100) END AS balance FROM customer"""


@query(
    "impute_constant",
    f"SELECT c_custkey, coalesce(c_mktsegment, 'Missing') AS c_mktsegment FROM ({GAPPY_CUSTOMER_SQL})",
)
def impute_constant(spark, folder) -> DataFrame:
    return impute.impute_constant(_gappy_customers(spark, folder).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query(
    "impute_cat_mode",
    f"""WITH g AS ({GAPPY_CUSTOMER_SQL})
    SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM g WHERE c_mktsegment IS NOT NULL
      GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS c_mktsegment FROM g""",
)
def impute_cat_mode(spark, folder) -> DataFrame:
    rows = _gappy_customers(spark, folder).select("c_custkey", "c_mktsegment")
    return impute.impute(rows, [], ["c_mktsegment"], "mode")


def _nation_mode(column: str) -> str:
    return f"""(SELECT c_nationkey, {column} AS m FROM (SELECT c_nationkey, {column},
      row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, {column}) AS rn FROM g
      WHERE {column} IS NOT NULL GROUP BY c_nationkey, {column}) WHERE rn = 1)"""


@query(
    "impute_mixed_mode",
    f"""WITH g AS ({GAPPY_CUSTOMER_SQL})
    SELECT g.c_custkey, g.c_nationkey, coalesce(g.c_mktsegment, s.m) AS c_mktsegment, coalesce(g.balance, b.m) AS balance
    FROM g LEFT JOIN {_nation_mode('c_mktsegment')} s ON s.c_nationkey = g.c_nationkey
           LEFT JOIN {_nation_mode('balance')} b ON b.c_nationkey = g.c_nationkey""",
)
def impute_mixed_mode(spark, folder) -> DataFrame:
    return impute.impute(_gappy_customers(spark, folder), ["c_nationkey"], ["c_mktsegment", "balance"], "mode")


@query(
    "impute_stats",
    " UNION ALL ".join(
        f"""SELECT l_suppkey, '{m}' AS method, '{c}' AS "column", {sql_rounded(f"{e}({c}{a})")} AS value
        FROM ({GAPPY_SQL}) WHERE is_train GROUP BY l_suppkey"""
        for m, e, a in (("mean", "avg", ""), ("median", "quantile_cont", ", 0.5"))
        for c in LINE_VALUES
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT l_suppkey, 'mode' AS method, '{c}' AS "column", m AS value FROM ({_mode_sql(c, GAPPY_SQL)})"""
        for c in LINE_VALUES
    ),
)
def impute_stats(spark, folder) -> DataFrame:
    out = impute.impute_stats(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, is_train=is_train())
    return out.withColumn("value", rounded("value"))


def _sequential_sql() -> str:
    cells = []
    for i, c in enumerate(LINE_VALUES):
        complete = " AND ".join(f"{p} IS NOT NULL" for p in LINE_VALUES[: i + 1])
        value = f"coalesce({c}, avg({c}) FILTER (WHERE is_train AND {complete}) {OVER_SUPPLIER})"
        cells.append(f"{sql_rounded(value)} AS {c}")
    any_null = " OR ".join(f"g_{c} IS NULL" for c in LINE_VALUES)
    raw = ", ".join(f"{c} AS g_{c}" for c in LINE_VALUES)
    return f"""SELECT {IDS}, is_train, {", ".join(LINE_VALUES)} FROM (
      SELECT {IDS}, is_train, {raw}, {", ".join(cells)} FROM ({GAPPY_SQL}))
    WHERE NOT (is_train AND ({any_null}))"""


@query("noclean", _sequential_sql())
def noclean(spark, folder) -> DataFrame:
    out = impute.no_clean(gappy_lines(spark, folder), SUPPLIER, LINE_VALUES, is_train())
    return out.select("l_suppkey", *LINE_ID, "is_train", *[rounded(c).alias(c) for c in LINE_VALUES])


@query(
    "drop_rows",
    f"""SELECT {IDS}, {", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in LINE_VALUES)} FROM ({GAPPY_SQL})
    WHERE qty IS NOT NULL AND price IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL""",
)
def drop_rows(spark, folder) -> DataFrame:
    out = impute.drop_rows(gappy_lines(spark, folder), LINE_VALUES)
    return out.select("l_suppkey", *LINE_ID, *[F.col(c).cast("double").alias(c) for c in LINE_VALUES])


# -- outliers -------------------------------------------------------------------------------------------------------

VALUES = ["qty", "price"]


def _fence_repair_sql(repair: str) -> str:
    """Fences, then the training statistic, then the statistic of the repaired training column for other rows."""
    stat = {"mean": "avg({x})", "median": "quantile_cont({x}, 0.5)"}[repair]
    fences = ", ".join(
        f"quantile_cont({c}, 0.25) FILTER (WHERE is_train) {OVER_SUPPLIER} AS q1_{c}, "
        f"quantile_cont({c}, 0.75) FILTER (WHERE is_train) {OVER_SUPPLIER} AS q3_{c}, "
        f"{stat.format(x=c)} FILTER (WHERE is_train) {OVER_SUPPLIER} AS s_{c}"
        for c in VALUES
    )
    flags = ", ".join(f"coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false) AS o_{c}" for c in VALUES)
    train = ", ".join(f"CASE WHEN is_train AND o_{c} THEN s_{c} ELSE {c} END AS t_{c}" for c in VALUES)
    again = ", ".join(
        f"""{sql_rounded(f"CASE WHEN NOT is_train AND o_{c} THEN {stat.format(x='t_' + c)} FILTER (WHERE is_train) {OVER_SUPPLIER} ELSE t_{c} END")} AS {c}"""
        for c in VALUES
    )
    return f"""SELECT {IDS}, {again} FROM (SELECT *, {train} FROM (SELECT *, {flags} FROM (
      SELECT *, {fences} FROM ({OUTLIER_SQL}))))"""


# a few wild cells, so that the rules have something to find
OUTLIER_SQL = f"""SELECT {IDS}, is_train, CASE WHEN (l_orderkey + l_linenumber) % 37 = 0 THEN qty * 40 ELSE qty END AS qty,
  CASE WHEN (l_orderkey + l_linenumber) % 41 = 0 THEN price * 25 ELSE price END AS price FROM ({GAPPY_SQL})"""


def _outlier_lines(spark, folder) -> DataFrame:
    mark = F.col("l_orderkey") + F.col("l_linenumber")
    return gappy_lines(spark, folder).select(
        "l_suppkey",
        *LINE_ID,
        "is_train",
        F.when(mark % 37 == 0, F.col("qty") * 40).otherwise(F.col("qty")).alias("qty"),
        F.when(mark % 41 == 0, F.col("price") * 25).otherwise(F.col("price")).alias("price"),
    )


def _values(out: DataFrame, digits: int = 6) -> DataFrame:
    return out.select("l_suppkey", *LINE_ID, *[rounded(c, digits).alias(c) for c in VALUES])


@query("outlier_iqr", _fence_repair_sql("mean"))
def outlier_iqr(spark, folder) -> DataFrame:
    return _values(outliers.repair_with_fences(_outlier_lines(spark, folder), SUPPLIER, VALUES, "mean", is_train()))


@query("outlier_iqr_median", _fence_repair_sql("median"))
def outlier_iqr_median(spark, folder) -> DataFrame:
    return _values(outliers.repair_with_fences(_outlier_lines(spark, folder), SUPPLIER, VALUES, "median", is_train()))


def _z_sql() -> str:
    own = "OVER (PARTITION BY l_suppkey, is_train)"
    cells = ", ".join(
        sql_rounded(
            f"CASE WHEN abs({c} - avg({c}) {own}) > 0.5 * stddev_pop({c}) {own} THEN"
            f" quantile_cont({c}, 0.5) FILTER (WHERE is_train) {OVER_SUPPLIER} ELSE {c} END"
        )
        + f" AS {c}"
        for c in VALUES
    )
    return f"SELECT {IDS}, {cells} FROM ({OUTLIER_SQL})"


@query("outlier_zscore", _z_sql())
def outlier_zscore(spark, folder) -> DataFrame:
    return _values(outliers.repair_with_z_scores(_outlier_lines(spark, folder), SUPPLIER, VALUES, "median", is_train()))


def _rule_sql(rule: str, k: float) -> str:
    train = f"FILTER (WHERE is_train) {OVER_SUPPLIER}"
    first, second, low, high = {
        "ZS": (
            f"avg({{c}}) {train} AS a_{{c}}, stddev_pop({{c}}) {train} AS b_{{c}}", "0 AS z_{c}",
            f"a_{{c}} - {k} * b_{{c}}", f"a_{{c}} + {k} * b_{{c}}",
        ),
        "IQR": (
            f"quantile_cont({{c}}, 0.25) {train} AS a_{{c}}, quantile_cont({{c}}, 0.75) {train} AS b_{{c}}", "0 AS z_{c}",
            f"a_{{c}} - {k} * (b_{{c}} - a_{{c}})", f"b_{{c}} + {k} * (b_{{c}} - a_{{c}})",
        ),
        "MAD": (
            f"quantile_cont({{c}}, 0.5) {train} AS a_{{c}}", f"quantile_cont(abs({{c}} - a_{{c}}), 0.5) {train} AS z_{{c}}",
            f"a_{{c}} - {k} * z_{{c}}", f"a_{{c}} + {k} * z_{{c}}",
        ),
    }[rule]
    one = ", ".join(first.format(c=c) for c in VALUES)
    two = ", ".join(second.format(c=c) for c in VALUES)
    inside = {c: f"({c} >= {low.format(c=c)} AND {c} <= {high.format(c=c)})" for c in VALUES}
    cells = ", ".join(
        sql_rounded(
            f"CASE WHEN {c} IS NULL OR {inside[c]} THEN {c} ELSE"
            f" coalesce(avg({c}) FILTER (WHERE is_train AND {inside[c]}) {OVER_SUPPLIER}, 0) END", 5
        )
        + f" AS {c}"
        for c in VALUES
    )
    return f"SELECT {IDS}, {cells} FROM (SELECT *, {two} FROM (SELECT *, {one} FROM ({OUTLIER_SQL})))"


def _rule_query(name: str, rule: str) -> None:
    kind, k = outliers.parse_rule(rule)

    @query(name, _rule_sql(kind, k))
    def run(spark, folder) -> DataFrame:
        return _values(outliers.clean_outliers(_outlier_lines(spark, folder), SUPPLIER, VALUES, rule, is_train()), 5)


for _name, _rule in (("clean_zs", "ZS_2"), ("clean_iqr", "IQR_1.5"), ("clean_mad", "MAD_2.5")):
    _rule_query(_name, _rule)


# -- scaling and binning --------------------------------------------------------------------------------------------


def _scale_sql(kind: str, clip: bool = True) -> str:
    train = f"FILTER (WHERE is_train) {OVER_SUPPLIER}"
    shift, spread = {
        "ZS": (f"avg({{c}}) {train}", f"stddev_pop({{c}}) {train}"),
        "MM": (f"min({{c}}) {train}", f"(max({{c}}) {train} - min({{c}}) {train})"),
        "MA": ("0", f"max(abs({{c}})) {train}"),
        "RS": (
            f"quantile_cont({{c}}, 0.5) {train}",
            f"(quantile_cont({{c}}, 0.75) {train} - quantile_cont({{c}}, 0.25) {train})",
        ),
    }[kind]
    cells = []
    for c in VALUES:
        a, b = shift.format(c=c), spread.format(c=c)
        value = f"({c} - {a}) / CASE WHEN {b} = 0 THEN 1 ELSE {b} END"
        if kind == "MM" and clip:
            value = f"CASE WHEN {c} IS NOT NULL THEN least(1.0, greatest(0.0, {value})) END"
        cells.append(f"{sql_rounded(value)} AS {c}")
    return f"SELECT {IDS}, {', '.join(cells)} FROM ({GAPPY_SQL})"


def _scale_query(name: str, kind: str, clip: bool = True) -> None:
    @query(name, _scale_sql(kind, clip))
    def run(spark, folder) -> DataFrame:
        rows = gappy_lines(spark, folder).select("l_suppkey", *LINE_ID, "is_train", *VALUES)
        return _values(scale.scale(rows, SUPPLIER, VALUES, kind, is_train(), clip))


for _name, _kind, _clip in (
    ("scale_zs", "ZS", True),
    ("scale_mm", "MM", True),
    ("scale_mm_open", "MM", False),
    ("scale_ma", "MA", True),
    ("scale_rs", "RS", True),
):
    _scale_query(_name, _kind, _clip)


def _uniform_sql() -> str:
    train = f"FILTER (WHERE is_train) {OVER_SUPPLIER}"
    cells = []
    for n in (5, 10, 20):
        raw = f"trunc((price - min(price) {train}) / ((max(price) {train} - min(price) {train}) / {n} + 1e-12))"
        cells.append(f"CASE WHEN price IS NOT NULL THEN CAST(least({n - 1}, greatest(0, {raw})) AS INTEGER) END AS bin_{n}")
    return f"SELECT {IDS}, {', '.join(cells)} FROM ({GAPPY_SQL})"


@query("bins_uniform", _uniform_sql())
def bins_uniform(spark, folder) -> DataFrame:
    rows = gappy_lines(spark, folder).select("l_suppkey", *LINE_ID, "is_train", "price")
    by = Grouping.of(rows, SUPPLIER)
    for n in (5, 10, 20):
        rows = bins.uniform_bins(rows.withColumn(f"bin_{n}", F.col("price")), by, [f"bin_{n}"], n, is_train())
    return rows.drop("is_train", "price")


def _quantile_bin_sql() -> str:
    cuts = ", ".join(
        f"""c{n} AS (SELECT l_suppkey, list(price ORDER BY price) AS cuts FROM (
          SELECT l_suppkey, price, row_number() OVER (PARTITION BY l_suppkey ORDER BY price) AS rn,
                 count(*) OVER (PARTITION BY l_suppkey) AS n FROM g WHERE is_train AND price IS NOT NULL)
        WHERE rn % greatest(1, CAST(round_even(n / {n}.0::DOUBLE, 0) AS BIGINT)) = 0 AND rn < n GROUP BY l_suppkey)"""
        for n in (5, 10, 20)
    )
    cells = ", ".join(
        f"CASE WHEN price IS NOT NULL THEN CAST(least({n - 1}, len(list_filter(c{n}.cuts, lambda x: x < price))) AS INTEGER) END AS bin_{n}"
        for n in (5, 10, 20)
    )
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.l_suppkey = g.l_suppkey" for n in (5, 10, 20))
    return f"""WITH g AS ({GAPPY_SQL}), {cuts}
    SELECT g.l_suppkey, l_orderkey, l_linenumber, l_partkey, {cells} FROM g {joins}"""


@query("bins_quantile", _quantile_bin_sql())
def bins_quantile(spark, folder) -> DataFrame:
    rows = gappy_lines(spark, folder).select("l_suppkey", *LINE_ID, "is_train", "price")
    by = Grouping.of(rows, SUPPLIER)
    for n in (5, 10, 20):
        rows = bins.quantile_bins(rows.withColumn(f"bin_{n}", F.col("price")), by, [f"bin_{n}"], n, is_train())
    return rows.drop("is_train", "price")


# -- encoding -------------------------------------------------------------------------------------------------------


@query(
    "label_encode",
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS type_code,
      dense_rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) - 1 AS price_code FROM part""",
)
def label_encode(spark, folder) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice")
    coded = encode.label_encode(rows, "p_type", "type_code")
    return encode.label_encode(coded, "p_retailprice", "price_code", keys=["p_type"]).drop("p_type", "p_retailprice")


# fixed values: the market segments and order priorities of the test tables
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in SEGMENTS)
    + f" FROM ({GAPPY_CUSTOMER_SQL})",
)
def one_hot(spark, folder) -> DataFrame:
    rows = _gappy_customers(spark, folder).select("c_custkey", "c_mktsegment")
    return encode.one_hot(rows, encode.categories(rows, ["c_mktsegment"]))


@query(
    "dummies_union",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in SEGMENTS)
    + " FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS c_mktsegment FROM customer)",
)
def dummies_union(spark, folder) -> DataFrame:
    """A category that only the test rows have still gets its column in both splits."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    test = rows.where(F.col("c_custkey") % 5 == 0).withColumn("split", F.lit("test"))
    train = rows.where(F.col("c_custkey") % 5 != 0)
    train = train.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")))
    train, test = encode.dummies_over_splits(train.withColumn("split", F.lit("train")), test, ["c_mktsegment"])
    return train.unionByName(test)


@query(
    "feature_concat",
    "SELECT c_custkey, c_acctbal, c_nationkey, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in SEGMENTS)
    + " FROM customer",
)
def feature_concat(spark, folder) -> DataFrame:
    rows = table(spark, folder, "customer")
    vocabulary = encode.categories(rows, ["c_mktsegment"])
    return encode.feature_block(rows, ["c_acctbal", "c_nationkey"], vocabulary, keep=["c_custkey"])


@query(
    "build_data",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY (c_custkey * 2654435761) % 1000003, c_custkey) AS rn, count(*) OVER () AS n,
        dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer)
    SELECT c_custkey, c_nationkey, c_acctbal, code AS c_mktsegment,
      CASE WHEN rn <= floor(0.2 * n) THEN 'test' WHEN rn <= 2 * floor(0.2 * n) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def build_data(spark, folder) -> DataFrame:
    """Customers to predict the segment of: the name is too wide, and one column has no value."""
    rows = table(spark, folder, "customer").withColumn("nothing", F.lit(None).cast("double"))
    return build(rows, "c_mktsegment", [(F.col("c_custkey") * 2654435761) % 1000003, "c_custkey"], max_categories=100)
