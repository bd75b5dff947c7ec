"""Table kernels: each takes DataFrames and parameters and returns a DataFrame.

Everything is a lazy composition of built-in expressions, so Catalyst sees the
whole plan. Kernels that check something raise ``KernelError`` with a category.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DateType, MapType, StringType, StructType, TimestampNTZType, TimestampType


class KernelError(ValueError):
    """A kernel's typed failure: ``category`` is schema, data_mapping, resource_limit, crs or plan."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def _known(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KernelError("schema", f"unknown columns: {missing}")


def _keys(keys) -> list[Column]:
    """('c' | ('c', 'desc')) in order, nulls last."""
    return [F.col(k).asc_nulls_last() if isinstance(k, str) else (F.col(k[0]).desc_nulls_last() if k[1] == "desc" else F.col(k[0]).asc_nulls_last()) for k in keys]


def _free(*frames: DataFrame):
    """A function that gives names no column of ``frames`` has; equal requests give equal names."""
    taken = {c.lower() for df in frames for c in df.columns}

    def name(wanted: str) -> str:
        while wanted.lower() in taken:
            wanted = f"_{wanted}"
        return wanted

    return name


def _reversed(keys) -> list[Column]:
    """The opposite order of ``_keys``, nulls first."""
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    return [F.col(c).asc_nulls_first() if way == "desc" else F.col(c).desc_nulls_first() for c, way in pairs]


# --- columns
def select_columns(df, columns):
    _known(df, columns)
    return df.select(*columns)


def drop_columns(df, columns, missing="error"):
    if missing == "error":
        _known(df, columns)
    return df.drop(*columns)


def rename(df, mapping):
    _known(df, [*mapping])
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise KernelError("schema", "a new name collides")
    return df.withColumnsRenamed(mapping)


def reorder_columns(df, order):
    _known(df, order)
    return df.select(*order, *(c for c in df.columns if c not in order))


def add_row_number(df, name, order_by, partition_by=(), start=1, parts=None):
    """Gap-free numbers. Without ``partition_by`` rows are dealt to ranges of the first key and numbered per range, on top of the counts of the ranges before; no single task sees all rows."""
    if partition_by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*_keys(order_by))).cast("long") + (start - 1))
    first, desc = (order_by[0], False) if isinstance(order_by[0], str) else (order_by[0][0], order_by[0][1] == "desc")
    if isinstance(df.schema[first].dataType, (StringType, BinaryType)):
        raise KernelError("plan", "a global row number needs a number, date or timestamp as its first key")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seconds = F.col(first).cast("timestamp").cast("double") if isinstance(df.schema[first].dataType, (DateType, TimestampNTZType)) else F.col(first).cast("double")
    key = -seconds if desc else seconds
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []  # one per range
    dealt = df.withColumn("_range", F.when(key.isNull(), len(cuts) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= key)) if cuts else F.lit(0)))
    counts, total, before = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()), start - 1, []
    for k, n in counts:
        before += [F.lit(k), F.lit(total)]
        total += n
    base = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0)
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*_keys(order_by))) + base.cast("long")).drop("_range")


def concat_columns(df, columns, output, sep="", null="skip"):
    parts = [F.col(c).cast("string") for c in columns]
    return df.withColumn(output, F.concat_ws(sep, *parts) if null == "skip" else F.concat(*[x for p in parts for x in (F.lit(sep), p)][1:]))


def split_column(df, column, sep, into, regex=False, extra="error"):
    """Pieces by position, null where there are fewer. ``extra``: with more pieces than columns, error, drop the surplus, or merge it into the last column."""
    if extra not in ("error", "drop", "merge"):
        raise KernelError("plan", f"unknown extra: {extra}")
    pattern = sep if regex else "\\Q" + sep + "\\E"
    pieces = F.split(column, pattern, len(into) if extra == "merge" else -1)
    if extra == "error":
        message = F.concat(F.lit(f"{column}: more than {len(into)} pieces in "), F.to_json(F.struct(F.col(column).alias("value"))))
        pieces = F.when(F.size(pieces) > len(into), F.raise_error(message).cast("array<string>")).otherwise(pieces)
    return df.withColumns({name: F.get(pieces, k) for k, name in enumerate(into)})


def coalesce(df, columns, output, default=None):
    return df.withColumn(output, F.coalesce(*map(F.col, columns), *([] if default is None else [F.lit(default)])))


def conditional(df, cases, otherwise, output):
    chain = reduce(lambda c, x: c.when(x[0], x[1]), cases[1:], F.when(*cases[0]))
    return df.withColumn(output, chain.otherwise(otherwise))


def formula(df, output, column: Column):
    return df.withColumn(output, column)


def expression(df, outputs: dict[str, Column]):
    return df.withColumns(outputs)


def type_cast(df, casts, mode="strict"):
    return df.withColumns({c: F.col(c).cast(t) if mode == "strict" else F.col(c).try_cast(t) for c, t in casts.items()})


def align_schema(df, target: StructType):
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target))


# --- rows
def filter(df, predicate: Column):
    return df.filter(predicate)


def sort(df, keys):
    return df.orderBy(*_keys(keys))


def limit(df, count, offset=0):
    return df.offset(offset).limit(count) if offset else df.limit(count)


def top_n(df, n, keys, partition_by=(), ties="row"):
    """The first ``n`` rows by ``keys`` (of each partition). ``ties``: row (n rows), rank (all that tie with the n-th) or dense (n different keys).

    Without a partition no task ranks the whole table: the key of the last rank that counts is found from ``n`` rows, and a filter keeps what is not behind it.
    """
    if ties not in ("row", "rank", "dense"):
        raise KernelError("plan", f"unknown ties: {ties}")
    if partition_by:
        rank, order = {"row": F.row_number, "rank": F.rank, "dense": F.dense_rank}[ties](), _free(df)("_rank")
        return df.withColumn(order, rank.over(Window.partitionBy(*partition_by).orderBy(*_keys(keys)))).where(F.col(order) <= n).drop(order)
    if ties == "row":
        return df.orderBy(*_keys(keys)).limit(n)
    names = [k if isinstance(k, str) else k[0] for k in keys]
    ranked = df.select(*names)
    first = (ranked.distinct() if ties == "dense" else ranked).orderBy(*_keys(keys)).limit(n)
    name = _free(df)
    last = first.orderBy(*_reversed(keys)).limit(1).select(*(F.col(c).alias(name(f"_last_{c}")) for c in names))
    # not behind the last one: before it at the first key that differs, or equal throughout
    kept, equal = F.lit(False), F.lit(True)
    for k in keys:
        column, down = (k, False) if isinstance(k, str) else (k[0], k[1] == "desc")
        own, its = F.col(column), F.col(name(f"_last_{column}"))
        before = F.coalesce(own > its if down else own < its, own.isNotNull() & its.isNull())  # nulls come last
        kept, equal = kept | (equal & before), equal & own.eqNullSafe(its)
    return df.join(F.broadcast(last), kept | equal, "left_semi").select(*df.columns)


def sample(df, fraction, seed, key):
    """Rows whose md5 of key and seed falls below the fraction: the same rows on any partitioning."""
    return df.where(F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long") < int(fraction * 2**32))


# --- joins
def join(df, right, on, how="inner", null_equal=False):
    """Equi-join; the key is kept once. on: name or list of names."""
    names = [on] if isinstance(on, str) else list(on)
    if not null_equal:
        return df.join(right, names, how)
    marked = right.select(*(F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns))
    out = df.join(marked, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names)), how)
    return out.drop(*(f"_r_{c}" for c in names))


def cross_join(df, right, max_rows=10_000_000):
    if (n := df.count() * right.count()) > max_rows:
        raise KernelError("resource_limit", f"{n} rows")
    return df.crossJoin(right)


def semi_join(df, right, on):
    return df.join(right, on, "left_semi")


def anti_join(df, right, on):
    return df.join(right, on, "left_anti")


def lookup(df, right, key, values, default=None, order_by=None, on_duplicate="first"):
    """Left-preserving: each key of ``right`` counts once, with the values of one of its rows.

    ``on_duplicate``: first (the row of the least ``order_by``, then of the least values; nulls last), last (of the greatest), or error.
    Without ``order_by`` the values alone decide, so the row is the same on every run.
    """
    if on_duplicate not in ("first", "last", "error"):
        raise KernelError("plan", f"unknown on_duplicate: {on_duplicate}")
    keys = [key] if isinstance(key, str) else list(key)
    if on_duplicate == "error" and not right.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))).groupBy(*keys).count().where("count > 1").isEmpty():
        raise KernelError("data_mapping", "keys of the right side repeat")
    one = _free(right, df)("_one")
    order = ([order_by] if isinstance(order_by, str) else list(order_by or ())) + list(values)
    # structs compare field by field with nulls first; a flag before each field puts them last
    row = F.struct(*(x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"null_{k}"), F.col(c).alias(f"by_{k}"))))
    first = right.groupBy(*keys).agg((F.max if on_duplicate == "last" else F.min)(row).alias(one))
    at = len(order) - len(values)
    found = first.select(*keys, *(F.col(f"{one}.by_{at + k}").alias(v) for k, v in enumerate(values)), F.lit(True).alias(one))
    out = df.join(found, keys, "left")
    if default is not None:  # for a key that is not there; a null that was looked up stays
        out = out.withColumns({v: F.when(F.col(one), F.col(v)).otherwise(F.lit(default)) for v in values})
    return out.drop(one)


def asof_join(df, right, left_time, right_time, by, values, direction="backward", tolerance=None, allow_exact=True):
    """One sorted pass over both sides together, by key: no range join.

    ``direction``: backward, forward or nearest (ties go back). ``tolerance``: the most that the times may
    differ, in seconds or in the unit of a number.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise KernelError("plan", f"unknown direction: {direction}")
    name = _free(df, right)
    t, side, of_right, back, ahead, chosen = map(name, ("_t", "_side", "_r", "_back", "_ahead", "_best"))
    matched = f"{right_time}_matched"
    found = right.select(F.struct(*values, right_time)).schema[0].dataType
    left = df.select("*", F.col(left_time).alias(t), F.lit(1).alias(side), F.lit(None).cast(found).alias(of_right))
    other = right.select(*by, F.col(right_time).alias(t), F.lit(0).alias(side), F.struct(*values, right_time).alias(of_right))
    # the right rows of one time count as earlier, or as later, as exact matches allow
    rank = lambda before: (F.col(side) if before == allow_exact else -F.col(side)).asc()
    before = Window.partitionBy(*by).orderBy(F.col(t).asc(), rank(True)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.col(t).desc(), rank(True)).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(other, allowMissingColumns=True)
    for column, way, window in ((back, "backward", before), (ahead, "forward", after)):
        both = both.withColumn(column, F.last(of_right, ignorenulls=True).over(window) if direction in ("nearest", way) else F.lit(None).cast(found))
    number = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6 if dict(df.dtypes)[left_time].startswith(("timestamp", "date")) else c.cast("double")
    apart = lambda column: F.abs(number(F.col(left_time)) - number(F.col(f"{column}.{right_time}")))
    best = F.when(F.col(ahead).isNull() | (apart(back) <= apart(ahead)), F.col(back)).otherwise(F.col(ahead))
    out = both.where(F.col(side) == 1).withColumn(chosen, best)
    if tolerance is not None:
        out = out.withColumn(chosen, F.when(apart(chosen) <= tolerance, F.col(chosen)))
    return out.select(*df.columns, *(F.col(f"{chosen}.{v}").alias(v) for v in values), F.col(f"{chosen}.{right_time}").alias(matched))


def fuzzy_join(df, right, left_on, right_on, max_distance):
    """All pairs within an edit distance, without comparing all pairs.

    A string cut into ``max_distance`` + 1 parts keeps one of them whole within so many edits, at most as many places
    away. So the right side is keyed by its parts, the left side by what could be those parts in strings of like
    length, and pairs of different values that meet are verified once.
    """
    d = max_distance
    cut = lambda n, i: F.floor(i * n / (d + 1)).cast("int")
    parts, shifts = F.sequence(F.lit(0), F.lit(d)), F.sequence(F.lit(-d), F.lit(d))
    lefts = df.select(F.col(left_on).alias("_a")).where("_a IS NOT NULL").distinct().withColumn("_n", F.length("_a"))
    rights = right.select(F.col(right_on).alias("_b")).where("_b IS NOT NULL").distinct().withColumn("_size", F.length("_b"))
    rights = rights.select("_b", "_size", F.explode(parts).alias("_i"))
    rights = rights.withColumn("_key", F.substring("_b", cut(F.col("_size"), F.col("_i")) + 1, cut(F.col("_size"), F.col("_i") + 1) - cut(F.col("_size"), F.col("_i"))))
    lefts = lefts.select("_a", "_n", F.explode(F.sequence(F.greatest(F.col("_n") - d, F.lit(0)), F.col("_n") + d)).alias("_size"))
    lefts = lefts.select("_a", "_n", "_size", F.explode(parts).alias("_i")).select("*", F.explode(shifts).alias("_s"))
    start, size = cut(F.col("_size"), F.col("_i")) + F.col("_s"), cut(F.col("_size"), F.col("_i") + 1) - cut(F.col("_size"), F.col("_i"))
    lefts = lefts.where((start >= 0) & (start + size <= F.col("_n"))).select("_a", "_size", "_i", F.substring("_a", start + 1, size).alias("_key")).distinct()
    pairs = lefts.join(rights, ["_size", "_i", "_key"]).select("_a", "_b").distinct().withColumn("distance", F.levenshtein("_a", "_b", d)).where("distance >= 0")
    a, b = map(_free(df, right), ("_a", "_b"))
    pairs = pairs.select(F.col("_a").alias(a), F.col("_b").alias(b), "distance")
    found = right.withColumn(b, F.col(right_on)).join(pairs, b)
    return df.withColumn(a, F.col(left_on)).join(found, a).drop(a, b)


# --- aggregation
_AGGREGATES = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "any": F.bool_or, "all": F.bool_and, "approx_count_distinct": F.approx_count_distinct}


def aggregate(df, group_by, aggs):
    """aggs: (function, column or Column, output)."""
    return df.groupBy(*group_by).agg(*(_AGGREGATES[f](c).alias(o) for f, c, o in aggs))


def statistics(df, columns):
    """One row per numeric column, from one pass."""
    one = df.agg(*(F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns))
    return one.select(F.inline(F.array(*columns)))


def bin(df, column, edges, output):
    """Index of the bin [edges[k], edges[k+1]); outside: null."""
    k = reduce(lambda acc, e: acc + (F.col(column) >= e).cast("int"), edges, F.lit(0))
    return df.withColumn(output, F.when((k > 0) & (k < len(edges)), k - 1))


def pivot(df, index, column, values, agg: Column):
    return df.groupBy(*index).pivot(column, values).agg(agg)


def _compared(df, right, keys, columns):
    a = df.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "matched").otherwise("changed")
    return a.join(b, keys, "full").withColumn("status", status)


def reconcile(df, right, keys, columns):
    return _compared(df, right, keys, columns).groupBy("status").agg(F.count("*").alias("n"))


def table_diff(df, right, keys, columns):
    out = _compared(df, right, keys, columns)
    changed = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns))), ",")
    return out.select(*keys, "status", F.when(F.col("status") == "changed", changed).alias("changed_columns"))


# --- windows
def window_function(df, column: Column, output, partition_by, order_by, frame=None):
    w = Window.partitionBy(*partition_by).orderBy(*_keys(order_by))
    return df.withColumn(output, column.over(w.rowsBetween(*frame) if frame else w))


def rolling_window(df, column, fn, size, output, partition_by, order_by, min_periods=1):
    w = Window.partitionBy(*partition_by).orderBy(*_keys(order_by)).rowsBetween(1 - size, 0)
    return df.withColumn(output, F.when(F.count(column).over(w) >= min_periods, _AGGREGATES[fn](column).over(w)))


# --- sets
def concat(inputs):
    return reduce(lambda a, b: a.union(b), inputs)


def concat_by_name(inputs, allow_missing=True):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), inputs)


def union_distinct(inputs):
    return concat(inputs).distinct()


def intersect(df, right, all=False):
    return df.intersectAll(right) if all else df.intersect(right)


def except_(df, right, all=False):
    return df.exceptAll(right) if all else df.subtract(right)


def distinct(df, columns=()):
    return df.select(*columns).distinct() if columns else df.distinct()


def dedup_advanced(df, keys, order_by, keep="first", flag=None):
    """``keep``: first or last by ``order_by`` (nulls count as last), none (rows whose key repeats go) or all_flagged (all rows stay, with ``flag``: whether a row is not the first)."""
    if keep not in ("first", "last", "none", "all_flagged"):
        raise KernelError("plan", f"unknown keep: {keep}")
    w, n = Window.partitionBy(*keys), _free(df)("_n")
    if keep == "none":
        return df.withColumn(n, F.count("*").over(w)).where(F.col(n) == 1).drop(n)
    place = F.row_number().over(w.orderBy(*(_reversed(order_by) if keep == "last" else _keys(order_by))))
    if keep == "all_flagged":
        return df.withColumn(flag or "is_duplicate", place > 1)
    return df.withColumn(n, place).where(F.col(n) == 1).drop(n)


# --- shapes
def melt(df, ids, values, variable="variable", value="value"):
    return df.unpivot(ids, values, variable, value)


def transpose(df, index, max_rows=1000):
    if df.limit(max_rows + 1).count() > max_rows:
        raise KernelError("resource_limit", f"more than {max_rows} rows")
    return df.transpose(index)


def explode(df, column, output, outer=False):
    return df.withColumn(output, (F.explode_outer if outer else F.explode)(column)).drop(column)


def unnest(df, column, prefix=""):
    fields = df.schema[column].dataType.names
    return df.select(*(c for c in df.columns if c != column), *(F.col(f"{column}.{f}").alias(prefix + f) for f in fields))


def flatten_json(df, column, schema: str, prefix=""):
    parsed = df.withColumn("_json", F.from_json(column, schema)).drop(column)
    return unnest(parsed, "_json", prefix)


# --- strings
def string_extract(df, column, pattern, group, output):
    return df.withColumn(output, F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, group)))


def string_length(df, column, output, unit="char"):
    return df.withColumn(output, {"char": F.char_length, "byte": F.octet_length, "bit": F.bit_length}[unit](F.col(column)))


def string_pad(df, column, width, fill=" ", side="left"):
    return df.withColumn(column, F.when(F.length(column) < width, (F.lpad if side == "left" else F.rpad)(column, width, fill)).otherwise(F.col(column)))


def _nfd_stripped(texts: pd.Series) -> pd.Series:
    """Letters without their marks."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))))


def _normal_form(form: str):
    """Spark has no normal forms; texts in ASCII are all of them already."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t)), "string")


_STEPS = {
    "trim": F.trim,
    "lower": F.lower,
    "upper": F.upper,
    "title": F.initcap,
    "collapse_ws": lambda c: F.regexp_replace(c, r"(?U)\s+", " "),
    "strip_punct": lambda c: F.regexp_replace(c, r"[\p{P}\p{S}]", ""),
    "nfc": lambda c: _normal_form("NFC")(c),
    "nfkc": lambda c: _normal_form("NFKC")(c),
    "strip_accents": lambda c: F.pandas_udf(_nfd_stripped, "string")(c),
}


def text_normalize(df, column, steps):
    """``steps`` in order. Punctuation and symbols are those of Unicode, so letters of every script stay."""
    if unknown := [x for x in steps if x not in _STEPS]:
        raise KernelError("plan", f"unknown steps: {unknown}")
    return df.withColumn(column, reduce(lambda c, s: _STEPS[s](c), steps, F.col(column)))


def replace(df, column, mapping=None, pattern=None, replacement=""):
    if mapping is not None:
        return df.withColumn(column, F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), F.col(column)), F.col(column)))
    return df.withColumn(column, F.regexp_replace(column, pattern, replacement))


# --- dates
_PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "dow": lambda c: F.weekday(c) + 1, "doy": F.dayofyear, "hour": F.hour, "minute": F.minute}


def date_extract(df, column, parts):
    return df.withColumns({f"{column}_{p}": _PARTS[p](F.col(column)) for p in parts})


def date_add(df, column, amount, unit, output):
    return df.withColumn(output, F.timestamp_add(unit.upper(), F.lit(amount), F.col(column)))


def date_diff(df, start, end, unit, output):
    return df.withColumn(output, F.timestamp_diff(unit.upper(), F.col(start), F.col(end)))


def date_format(df, column, pattern, output):
    return df.withColumn(output, F.date_format(column, pattern))


def timezone_convert(df, column, source, target, output):
    return df.withColumn(output, F.convert_timezone(F.lit(source), F.lit(target), F.col(column)))


# --- nulls, hashes, privacy
def fill_na(df, columns):
    return df.fillna(columns)


def fill_forward(df, column, partition_by, order_by):
    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(*partition_by).orderBy(*_keys(order_by)).rowsBetween(Window.unboundedPreceding, 0)))


_UNIT = "\x1f"


def _canonical(columns):
    return F.concat_ws(_UNIT, *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))


def md5_hash(df, columns, output):
    return df.withColumn(output, F.md5(_canonical(columns)))


def sha256_hash(df, columns, output):
    return df.withColumn(output, F.sha2(_canonical(columns), 256))


def hmac_sha256(df, columns, key: bytes, output):
    """RFC 2104 from two digests; the key shows in the plan, so resolve it as late as possible."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, _canonical(columns).cast("binary")), 256))
    return df.withColumn(output, F.sha2(F.concat(outer, first), 256))


def uuid_generator(df, output, names, namespace="6ba7b811-9dad-11d1-80b4-00c04fd430c8"):
    """Version 5: name-based, the same on every run."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), _canonical(names).cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return df.withColumn(output, F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)))


def mask_data(df, column, keep_first=0, keep_last=0, char="*"):
    n = F.length(column)
    hidden = F.greatest(n - keep_first - keep_last, F.lit(0))
    masked = F.concat(F.substring(column, 1, keep_first), F.repeat(F.lit(char), hidden), F.right(column, F.lit(keep_last)))
    return df.withColumn(column, F.when(n > keep_first + keep_last, masked).otherwise(F.repeat(F.lit(char), n)))


def _encoded(df, columns):
    """A row's values as one text that gives them back: type, length and text of each, so that no two rows share one. Times are in UTC."""
    def one(field):
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, (StructType, ArrayType, MapType)):
            text = F.to_json(F.struct(c.alias("v")), {"timeZone": "UTC"})
        elif isinstance(kind, TimestampType):
            text = F.unix_micros(c).cast("string")
        elif isinstance(kind, BinaryType):
            text = F.hex(c)
        else:
            text = c.cast("string")
        return F.when(c.isNull(), F.lit("n;")).otherwise(F.concat(F.lit(f"{kind.simpleString()}:"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")))

    return F.concat(*(one(df.schema[c]) for c in columns))


def stable_fingerprint(df, columns):
    """One row: count, and the sum of the first 15 hex digits of each row's SHA-256. The same for any order, partitioning and time zone of the session."""
    part = F.conv(F.substring(F.sha2(_encoded(df, sorted(columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


# --- assertions: report gives counts; fail raises
def _asserted(df, broken: Column, mode, output="violations"):
    report = df.agg(F.count_if(broken).alias(output), F.count("*").alias("rows"))
    if mode == "fail" and (n := report.first()[0]):
        raise KernelError("data_mapping", f"{n} rows violate the assertion")
    return df if mode == "fail" else df.withColumn("violates", F.coalesce(broken, F.lit(False))) if mode == "flag" else report


def assert_not_null(df, columns, mode="report"):
    return _asserted(df, reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)), mode)


def assert_range(df, column, low, high, mode="report"):
    return _asserted(df, ~F.col(column).between(low, high), mode)


def assert_regex(df, column, pattern, mode="report"):
    return _asserted(df, ~F.col(column).rlike(f"^(?:{pattern})$"), mode)


def assert_unique(df, columns, mode="report"):
    repeated = df.groupBy(*columns).count().where("count > 1")
    report = repeated.agg(F.count("*").alias("repeated_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows_of_repeated_keys"))
    if mode == "fail" and report.first()[0]:
        raise KernelError("data_mapping", "keys repeat")
    return df if mode == "fail" else report


def assert_cardinality(df, columns, low, high):
    return df.agg(F.count_distinct(*columns).alias("n")).select("n", F.col("n").between(low, high).alias("holds"))


def assert_foreign_key(df, right, key):
    return df.where(F.col(key).isNotNull()).join(right, key, "left_anti").agg(F.count("*").alias("orphans"))


def assert_schema(df, expected: dict[str, DataType]):
    have = {f.name: f.dataType for f in df.schema}
    if wrong := {c: t for c, t in expected.items() if have.get(c) != t}:
        raise KernelError("schema", f"differs: {sorted(wrong)}")
    return df


def assert_metadata(df, column, expected: dict):
    have = df.schema[column].metadata
    if wrong := {k for k, v in expected.items() if have.get(k) != v}:
        raise KernelError("schema", f"metadata differ: {sorted(wrong)}")
    return df


def validate_rules(df, rules: dict[str, Column]):
    """Every rule in one pass: rule, violations (null counts as one), passed."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()))
    out = one.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules))))
    return out.withColumn("passed", F.col("violations") == 0)
