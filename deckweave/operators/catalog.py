"""Operators on course catalogues and module lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckweave.functions import text as T
from deckweave.functions import urls as U
from deckweave.operators.audit import first_tier
from deckweave.session import cut


def keep_first(df: DataFrame, keys: list[Column], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the ascending order of some columns, nulls first; null keys are a key like any other."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*(k.alias(f"_key_{i}") for i, k in enumerate(keys))).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Adds each row's place in its group, from 1, in an order that should tell rows apart.

    Ranges of (group, order) are numbered each for itself and the counts of the
    ranges before are added, so that a hot group is spread over as many tasks as
    it fills; a window by the group alone would have it in one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))  # read twice, and the ranges must stay
    local = own.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    counts = own.groupBy(*group, "_part").agg(F.count("*").alias("_many"))
    before = F.coalesce(F.sum("_many").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(g).alias(f"_c_{g}") for g in group), F.col("_part").alias("_c_part"), before.alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(f"_c_{g}")) for g in group] + [F.col("_part") == F.col("_c_part")]
    return local.join(counts, same).select(*df.columns, (F.col("_before") + F.col("_at")).alias(out))


def cluster_columns(nodes: DataFrame, plan: list[str], column: str = "col", status: str = "status") -> DataFrame:
    """(plan..., index, column, nodes, has_pending, all_passed): terms of a plan, numbered by column."""
    own = nodes.groupBy(*plan, column).agg(
        F.count("*").alias("nodes"), F.bool_or(F.col(status).isin("pending", "unknown")).alias("has_pending"), F.bool_and(F.col(status) == "passed").alias("all_passed")
    )
    index = F.row_number().over(Window.partitionBy(*plan).orderBy(column)) - 1
    return own.select(*plan, index.alias("index"), column, "nodes", "has_pending", "all_passed")


def current_term(columns: DataFrame, plan: list[str], mode: str = "regular") -> DataFrame:
    """The first term of each plan with something pending and nothing unpassed before it; plans without one have no row.

    Only the regular mode exists; terms of irregular plans aren't made out.
    """
    if mode != "regular":
        raise NotImplementedError(f"term mode {mode!r}: only regular plans are supported")
    before = Window.partitionBy(*plan).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    open_ = columns.withColumn("_ready", F.coalesce(F.bool_and("all_passed").over(before), F.lit(True))).where("_ready AND has_pending").drop("_ready")
    return keep_first(open_, [F.col(p) for p in plan], ["index"])


def chosen(rows: DataFrame, picks: str, order: list[str]) -> DataFrame:
    """Rows picked by 1-based ordinals such as "3, 1, x, 3"; what is no ordinal of a row is ignored, and if none is left all rows are taken, without ordinals."""
    numbers = sorted({int(t) for t in picks.split(",") if t.strip().isdigit()})
    own = rows.orderBy(*order).limit(max(numbers, default=0)).withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))  # a top-k, never the whole table in one task
    hit = own.where(F.col("ordinal").isin(numbers))
    return first_tier([hit, rows.withColumn("ordinal", F.lit(None).cast("int"))]).drop("tier")


def file_base(ordinal: Column, title: Column) -> Column:
    return F.concat(T.numbered(ordinal), F.lit("-"), T.safe_name(title))


def first_asset(links: DataFrame, group: list[str], url: str, order: list[str]) -> DataFrame:
    """(group..., url): the first pdf of a group, else its first slide deck, else its first address; empty if all are null."""
    kind = F.when(U.asset_type(F.col(url)) == "pdf", 0).when(U.asset_type(F.col(url)).isin("ppt", "pptx"), 1).otherwise(2)
    real = F.col(url).isNotNull() & (F.col(url) != "")
    return links.groupBy(*group).agg(F.coalesce(F.min_by(F.when(real, F.col(url)), F.when(real, F.struct(kind.alias("kind"), *order))), F.lit("")).alias(url))


def _asks(requests: DataFrame, host: Column, cookies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with an equal key: a request's host and each domain above it, and a cookie's domain without its dot."""
    return requests.withColumn("_domain", F.explode(U.suffixes(host))), cookies.withColumn("_domain", F.regexp_replace(F.lower("domain"), "^\\.", ""))


def cookie_headers(requests: DataFrame, cookies: DataFrame, keys: list[str], url: str, now: int) -> DataFrame:
    """(keys..., header): the cookies that go with each request, in the jar's order; requests without any have an empty header.

    Hosts meet cookies by the domains above them, an equal key, so that a jar of
    any size is joined by hash; path, scheme and expiry are checked after.
    """
    asks, jar = _asks(requests.select(*keys, F.col(url).alias("_url")).distinct(), U.host(F.col("_url")), cookies)
    match = U.cookie_matches(F.col("_url"), F.col("domain"), F.col("path"), F.col("expires"), F.col("secure"), now)
    pair = F.struct("cookie_no", F.concat_ws("=", "name", "value").alias("text"))
    hits = asks.join(jar, "_domain").where(match).groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("all"))
    out = requests.select(*keys).distinct().join(hits.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return out.select(*keys, F.coalesce(F.array_join(F.expr("transform(all, c -> c.text)"), "; "), F.lit("")).alias("header"))


def alive_hosts(hosts: DataFrame, cookies: DataFrame, host: str, now: int) -> DataFrame:
    """(host, alive) of each host: whether an unexpired cookie of it holds a session."""
    asks, jar = _asks(hosts.select(host).distinct(), F.col(host), cookies.where(_holds_session(now)))
    hit = asks.join(jar, "_domain", "left_semi").select(host).distinct().withColumn("alive", F.lit(True))
    return hosts.select(host).distinct().join(hit, host, "left").select(host, F.coalesce("alive", F.lit(False)).alias("alive"))


def _holds_session(now: int) -> Column:
    return ((F.col("expires") <= 0) | (F.col("expires") >= now)) & F.col("name").rlike(U.SESSION)


def normal_cookies(raw: DataFrame, default_domain: str) -> DataFrame:
    """Cookies with a name, defaults put in for what is missing."""
    own = raw.where(T.strip(F.coalesce("name", F.lit(""))) != "")
    return own.select(
        "cookie_no", T.strip(F.col("name")).alias("name"), F.coalesce("value", F.lit("")).alias("value"), T.strip(T.or_else(F.col("domain"), F.lit(default_domain))).alias("domain"),
        T.or_else(T.strip(T.or_else(F.col("path"), F.lit("/"))), F.lit("/")).alias("path"), F.coalesce("expires", F.lit(-1)).cast("bigint").alias("expires"),
        F.coalesce("http_only", F.lit(False)).alias("http_only"), F.coalesce("secure", F.lit(False)).alias("secure"), T.or_else(F.col("same_site"), F.lit("Lax")).alias("same_site"),
    )


def session_alive(cookies: DataFrame, host: str, now: int) -> DataFrame:
    """(alive,): whether an unexpired cookie of the host holds a session; false for an empty jar."""
    fits = U.domain_matches(F.col("domain"), F.lit(host)) & _holds_session(now)
    return cookies.agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("alive"))


def netscape_lines(cookies: DataFrame) -> DataFrame:
    """(cookie_no, line) in the tab-separated format of cookie files."""
    dotted = F.when(F.col("domain").startswith("."), F.col("domain")).otherwise(F.concat(F.lit("."), F.col("domain")))
    expiry = F.when(F.col("expires") > 0, F.col("expires")).otherwise(0).cast("string")
    return cookies.select("cookie_no", F.concat_ws("\t", dotted, F.lit("TRUE"), F.col("path"), F.when(F.col("secure"), "TRUE").otherwise("FALSE"), expiry, "name", "value").alias("line"))


def download_status(url: Column, error: Column) -> Column:
    """What became of a download: no address of a deck, a failure, or ok; ``url`` is resolved to the file it leads to where it leads to one."""
    best = F.coalesce(F.nullif(U.asset_url(url), F.lit("")), url, F.lit(""))
    return F.when((best == "") | (U.asset_type(best) == "unknown"), "no-asset-url").when(error.isNotNull(), "download-failed").otherwise("ok")


def extract_status(path: Column, ext: Column, status: Column) -> Column:
    """A deck that isn't there or is no pdf keeps its row, as no-pdf unless it has a status."""
    return F.when(path.isNull() | (F.coalesce(ext, F.lit("")) != "pdf"), F.coalesce(status, F.lit("no-pdf"))).otherwise("extracted")
