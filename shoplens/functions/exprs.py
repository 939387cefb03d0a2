"""Column expressions shared by the operators.

All of them are built-in Spark expressions -- no Python UDF -- so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplens import constants as K

NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_map(d: Mapping[str, str]) -> Column:
    """Literal ``map<string,string>`` for code lookups (no join needed)."""
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# ---------------------------------------------------------------- money / rounding
def dec(c: Column | str, p: int = 14, s: int = 2) -> Column:
    return col(c).cast(f"decimal({p},{s})")


def money_out(c: Column | str, digits: int = 2) -> Column:
    """Round a decimal money value HALF_UP and hand it out as double."""
    return F.round(col(c), digits).cast("double")


def ratio(num: Column | str, den: Column | str, digits: int | None = None) -> Column:
    """num/den in double, null when den is 0 or null; optional rounding."""
    r = F.try_divide(col(num).cast("double"), F.nullif(col(den).cast("double"), F.lit(0.0)))
    return F.round(r, digits) if digits is not None else r


def valid_gmv(gmv: str = "gmv", status: str = "status") -> Column:
    """gmv of a non-refunded order, else 0 (the dashboard's GMV rule, F8)."""
    return F.when(F.col(status) != K.REFUNDED, F.col(gmv)).otherwise(F.lit(0).cast("decimal(14,2)"))


def gmv_expr(refunds: str = "exclude") -> Column:
    if refunds == "exclude":
        return valid_gmv()
    if refunds == "include":
        return F.col("gmv")
    raise ValueError("refunds must be 'exclude' or 'include'")


def sum0(c: Column, zero: str = "decimal(14,2)") -> Column:
    """``coalesce(sum(c), 0)`` typed like the summed column."""
    return F.coalesce(F.sum(c), F.lit(0).cast(zero))


# ---------------------------------------------------------------- filters
def shop_filter(shop_ids: Sequence[str] | None, c: str = "shop_id") -> Column | None:
    """None/[] = all shops; '' = the default shop (null id); others IN."""
    if not shop_ids:
        return None
    named = [s for s in shop_ids if s not in ("", None)]
    conds = []
    if any(s in ("", None) for s in shop_ids):
        conds.append(F.col(c).isNull())
    if named:
        conds.append(F.col(c).isin(named))
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return out


def platform_filter(platform: str | None, c: str = "platform") -> Column | None:
    """validated platform equality."""
    if not platform:
        return None
    if platform not in K.PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}")
    return F.col(c) == platform


def suspicious(flag: str = "is_suspicious", eng: str = "engagement_rate", conv: str = "conversion_rate",
               min_engagement: float = K.SUSPICIOUS_MIN_ENGAGEMENT,
               max_conversion: float = K.SUSPICIOUS_MAX_CONVERSION) -> Column:
    """flagged, or high engagement with a known, very low conversion."""
    rule = (F.coalesce(F.col(eng), F.lit(0.0)) >= min_engagement) & F.col(conv).isNotNull() & (F.col(conv) < max_conversion)
    return F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(rule, F.lit(False))


def attach(base, one_row):
    """Add the columns of a one-row frame to every row of ``base`` through a
    scalar subquery: the row is computed once and read as a value -- no join."""
    r = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns])).scalar()
    return base.select("*", r.alias("_one")).select(
        *[F.col(f"`{c}`") for c in base.columns], *[F.col("_one")[c].alias(c) for c in one_row.columns])


def ranked_lines(bounded, order, line, name: str):
    """One row: ``line(number)`` of every row of a top-k frame, numbered from 1
    in ``order``, joined by line breaks ('' without rows)."""
    from pyspark.sql import Window as W
    i = F.row_number().over(W.orderBy(*order))  # a few rows at most
    rows = bounded.withColumn("_i", i).select("_i", line(F.col("_i")).alias("_line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda x: x["_line"]), "\n").alias(name))


def exists(df) -> Column:
    """Scalar: does ``df`` hold at least one row (reads at most one row per task)."""
    return df.limit(1).select(F.count(F.lit(1)) > 0).scalar()


def all_of(conds: Iterable[Column | None]) -> Column | None:
    out = None
    for c in conds:
        if c is None:
            continue
        out = c if out is None else (out & c)
    return out


# ---------------------------------------------------------------- dirty numbers
def _strip_number(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"[,¥￥$]", "")


def parse_dirty_number(c: Column | str) -> Column:
    """Trim; drop , ¥ ￥ $; one suffix % (x0.01), 万 (x1e4) or k/K (x1e3).

    Unparseable or null -> null.  The numeric body is checked with a regex
    before the cast so ANSI mode never raises.
    """
    s = _strip_number(col(c).cast("string"))
    mult = (F.when(s.endswith("%"), F.lit(0.01))
             .when(s.endswith("万"), F.lit(10000.0))
             .when(F.lower(s).endswith("k"), F.lit(1000.0))
             .otherwise(F.lit(1.0)))
    has_suffix = s.endswith("%") | s.endswith("万") | F.lower(s).endswith("k")
    body = F.trim(F.when(has_suffix, F.regexp_replace(s, r".$", "")).otherwise(s))
    num = F.when(body.rlike(NUM_RE), body.cast("double"))
    return num * mult


def parse_feed_number(c: Column | str, out: str = "double") -> Column:
    """Drop , and % (no /100); k -> 1e3, m -> 1e6; null/''/unparseable -> 0.

    ``out='int'`` truncates toward zero like the legacy int cast.
    """
    s = F.regexp_replace(F.trim(col(c).cast("string")), r"[,%]", "")
    low = F.lower(s)
    mult = F.when(low.endswith("k"), F.lit(1000.0)).when(low.endswith("m"), F.lit(1000000.0)).otherwise(F.lit(1.0))
    body = F.when(low.endswith("k") | low.endswith("m"), F.regexp_replace(s, r".$", "")).otherwise(s)
    num = F.coalesce(F.when(body.rlike(NUM_RE), body.cast("double")) * mult, F.lit(0.0))
    if out == "int":
        return F.when(num >= 0, F.floor(num)).otherwise(F.ceil(num)).cast("bigint")
    return num


def fen_to_yuan(c: Column | str) -> Column:
    """Integer cents -> decimal(14,2) yuan; null/unparseable -> 0."""
    s = F.trim(col(c).cast("string"))
    v = F.when(s.rlike(r"^[+-]?\d+$"), s.cast("decimal(20,0)"))
    return F.coalesce((v / 100).cast("decimal(14,2)"), F.lit(0).cast("decimal(14,2)"))


# ---------------------------------------------------------------- times
def epoch_to_ts(c: Column | str, ms_mode: str = "floor") -> Column:
    """Epoch seconds or milliseconds (>= 1e12 means ms) -> UTC timestamp.

    ``ms_mode='floor'`` drops sub-second milliseconds (platform A),
    ``'fraction'`` keeps them (platform B).
    """
    s = F.trim(col(c).cast("string"))
    v = F.when(s.rlike(r"^[+-]?\d+(\.\d+)?$"), s.cast("double"))
    if ms_mode == "floor":
        secs = F.when(v >= 1e12, F.floor(v / 1000)).otherwise(F.floor(v))
        return F.timestamp_seconds(secs.cast("bigint"))
    return F.when(v >= 1e12, F.timestamp_millis(F.floor(v).cast("bigint"))).otherwise(F.timestamp_seconds(v))


# Text datetime shapes, tried in order: (shape regex, parse format).  The
# regex guard means a parser runs only on text it can match -- failing parses
# are expensive, and pandas-style lenient parsing accepts these shapes.
TEXT_TIME_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d H:mm:ss.SSSSSS"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
]


def text_to_ts(c: Column | str, shapes=TEXT_TIME_SHAPES) -> Column:
    """The first shape that matches decides the format; text that
    matches no shape, or an impossible date, -> null."""
    s = F.trim(col(c).cast("string"))
    t = F.regexp_replace(s, "T", " ")
    out = None
    for rx, fmt in shapes:
        # 'SSSSSS' parses 1 to 6 fraction digits
        parsed = F.try_to_timestamp(t, F.lit(fmt))
        out = F.when(s.rlike(rx), parsed) if out is None else out.when(s.rlike(rx), parsed)
    return out


def iso_to_ts(c: Column | str) -> Column:
    """ISO-8601 with 'Z', an offset, or naive (= UTC); failures -> null."""
    s = F.trim(col(c).cast("string"))
    zoned = s.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    with_zone = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
                           F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X")))
    return F.when(zoned, with_zone).otherwise(text_to_ts(s))


def any_time(c: Column | str) -> Column:
    """A time field that may be epoch (s/ms) or text."""
    s = F.trim(col(c).cast("string"))
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), epoch_to_ts(s)).otherwise(text_to_ts(s))


def hours_between(a: Column | str, b: Column | str) -> Column:
    """(b - a) in hours as double."""
    return (col(b).cast("double") - col(a).cast("double")) / 3600.0


def day_str(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


# ---------------------------------------------------------------- text / first-of
def _blank_to_null(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.trim(s) != "", s)


def first_truthy(*cols: Column | str, default: Column | None = None) -> Column:
    """X8 for text fields (ids, names, codes): first value not null and not ''.

    A text "0" is truthy in the source system, so ids like "0" are kept.
    """
    parts = []
    for c in cols:
        s = col(c).cast("string")
        parts.append(F.when(s.isNotNull() & (s != ""), s))
    if default is not None:
        parts.append(default.cast("string"))
    return F.coalesce(*parts)


def first_truthy_num(*cols: Column | str, default: Column | None = None) -> Column:
    """X8 for numeric fields: null, '' and a zero number fall through.

    With STRING-typed JSON a number 0 arrives as "0" (or "0.0"), so those fall
    through; the text "0.00" stays truthy, as in the source system.
    """
    parts = []
    for c in cols:
        s = col(c).cast("string")
        ok = s.isNotNull() & (s != "") & ~s.isin("0", "0.0")
        parts.append(F.when(ok, s))
    if default is not None:
        parts.append(default.cast("string"))
    return F.coalesce(*parts)


def first_nonempty(*cols: Column | str, default: Column | None = None) -> Column:
    """First value that is not null and not '' (0 is kept)."""
    parts = [F.when(col(c).cast("string") != "", col(c).cast("string")) for c in cols]
    if default is not None:
        parts.append(default.cast("string"))
    return F.coalesce(*parts)


def truncate(c: Column | str, n: int) -> Column:
    """Keep the first ``n`` characters."""
    return F.substring(col(c), 1, n)


def status_platform_a(c: Column | str) -> Column:
    """Platform A status, lower-cased lookup, unknown -> paid."""
    return F.coalesce(lit_map(K.PLATFORM_A_STATUS)[F.lower(F.trim(col(c)))], F.lit("paid"))


def status_platform_b(c: Column | str) -> Column:
    """Platform B status, case-sensitive lookup, missing/unknown -> paid."""
    return F.coalesce(lit_map(K.PLATFORM_B_STATUS)[col(c)], F.lit("paid"))


def label(c: Column | str, labels: Mapping[str, str]) -> Column:
    """Display label, falling back to the code itself."""
    return F.coalesce(lit_map(labels)[col(c)], col(c))


def bucket(c: Column | str, edges: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Label of the first ``[lo, hi)`` bucket containing the value; null stays null."""
    x = col(c)
    expr = None
    for name, lo, hi in edges:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (x >= lo)
        if hi is not None:
            cond = cond & (x < hi)
        expr = F.when(x.isNotNull() & cond, F.lit(name)) if expr is None else expr.when(x.isNotNull() & cond, F.lit(name))
    return expr


def is_html(c: Column | str) -> Column:
    """Payload text that starts like an HTML document; only its start is
    looked at, once."""
    starts = "|".join(rf"\Q{p}\E" for p in K.HTML_PREFIXES)
    return F.coalesce(col(c).rlike(rf"(?i)^\s*({starts})"), F.lit(False))


def verdict(delta: Column | str, higher_is_better: Column | str) -> Column:
    """Good when there is no delta, else (delta >= 0) == higher_is_better."""
    return F.when(col(delta).isNull(), F.lit(True)).otherwise((col(delta) >= 0) == col(higher_is_better))


def score_band(c: Column | str) -> Column:
    """Match score band."""
    return F.when(col(c) >= 80, "high").when(col(c) >= 60, "medium").otherwise("low")


# ---------------------------------------------------------------- X19 display formatting
def fmt_yuan(c: Column | str) -> Column:
    """'¥1,234.50' (two decimals, thousands separators)."""
    return F.concat(F.lit("¥"), F.format_number(col(c).cast("double"), 2))


def fmt_thousands(c: Column | str) -> Column:
    """'1,234' (integer with thousands separators)."""
    return F.format_number(col(c).cast("double"), 0)


def fmt_roi(c: Column | str) -> Column:
    """'3.50', or 'N/A' when missing (format_string would print 'nu' for null)."""
    v = col(c).cast("double")
    return F.when(v.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", v))


def fmt_kpi(value: Column | str, fmt: Column | str, currency: str = "฿") -> Column:
    """Dashboard KPI text: '-' for null or 0; currency = symbol + rounded
    integer with separators, percent = one decimal + '%', else integer."""
    v = col(value).cast("double")
    f = col(fmt)
    rounded = F.format_number(F.round(v, 0), 0)
    text = (F.when(f == "currency", F.concat(F.lit(currency), rounded))
             .when(f == "percent", F.concat(F.format_string("%.1f", v), F.lit("%")))
             .otherwise(rounded))
    return F.when(v.isNull() | (v == 0), F.lit("-")).otherwise(text)


def fmt_date_short(c: Column | str) -> Column:
    """'YYYY-MM-DD' -> 'MM-DD'."""
    return F.substring(col(c), 6, 5)


def fmt_followers(c: Column | str, wan_label: str = "万") -> Column:
    """'15.2 万' from 10,000 up, else separators; '—' when missing."""
    n = col(c).cast("double")
    return (F.when(n.isNull(), F.lit("—"))
             .when(n >= 10000, F.concat(F.format_string("%.1f", n / 10000), F.lit(" " + wan_label)))
             .otherwise(F.format_number(n, 0)))
