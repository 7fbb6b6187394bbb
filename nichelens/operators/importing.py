"""Dirty export rows to validated rows, channel identity and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.normalize import (
    build_dedupe_key,
    clean_text,
    detect_platform,
    let,
    looks_like_handle,
    normalize_handle,
    normalize_header,
    normalize_url,
    parse_date,
    parse_decimal,
    parse_int,
    parse_money,
    parse_percent,
    slugify,
)
from nichelens.session import literal_table, materialize
from nichelens.vocab import COMPLETED_IMPORTS

# Accepted headers per field; a tuple adds (scale, percent points, currency).
COLUMN_ALIASES = {
    "channel_name": (
        "Канал", "Название канала", "Имя канала", "Площадка", "Channel", "Channel name", "Title",
    ),
    "channel_url": ("Ссылка", "Ссылка на канал", "Адрес", "URL", "Link", "Channel URL"),
    "channel_external_id": (
        "ID канала", "Идентификатор", "Идентификатор канала", "Channel ID", "External ID",
    ),
    "platform": ("Платформа", "Мессенджер", "Platform", "Messenger"),
    "category": (
        "Категория", "Категория канала", "Тематика", "Рубрика", "Ниша", "Category", "Topic", "Niche",
    ),
    "subscribers": (
        "Подписчики", "Количество подписчиков", "Подписчиков", "Аудитория", "Subscribers", "Audience",
    ),
    "err": (
        "ERR", ("ERR, %", 1, True, None), ("ERR %", 1, True, None),
        "Вовлеченность", "Вовлечённость", "Engagement rate",
    ),
    "predicted_views": (
        "Прогноз просмотров", "Просмотры", ("Просмотры, тыс", 1000, False, None),
        "Охват", "Predicted views", "Views", "Reach",
    ),
    "cpv": (
        "CPV", ("CPV, RUB", 1, False, "RUB"),
        "Цена за просмотр", "Стоимость просмотра", "Cost per view",
    ),
    "campaign_price": (
        "Стоимость размещения", ("Прогноз цены, RUB", 1, False, "RUB"),
        "Стоимость", "Цена", "Бюджет", "Price", "Campaign price",
    ),
    "currency": ("Валюта", "Currency"),
    "region": ("Регион", "Гео", "Region", "Geo"),
    "snapshot_date": ("Дата", "Дата выгрузки", "Период", "Date", "Snapshot date"),
}
REQUIRED_FIELDS = ("channel_name",)
ERR_SUSPICIOUS = 5
DUPLICATE_WARNING = (
    "duplicate channel+date within the file; snapshot from the first occurrence kept"
)


def alias_table(spark, aliases: dict | None = None) -> DataFrame:
    """``(alias, field, scale, percent_points, currency)``; one field per alias."""
    rows = []
    for field, entries in (aliases or COLUMN_ALIASES).items():
        for entry in entries:
            header, scale, points, currency = (
                entry if isinstance(entry, tuple) else (entry, 1, False, None)
            )
            rows.append((header, field, int(scale), bool(points), currency))
    schema = {
        "header": "string", "field": "string", "scale": "int", "percent_points": "boolean",
        "currency": "string",
    }
    table = literal_table(spark, rows, schema).withColumn(
        "alias", normalize_header(F.col("header"))
    )
    return table.drop("header").dropDuplicates(["alias", "field"])


def map_columns(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Role of every header cell of ``headers(import_id, headers array<string>)``.

    ``status`` is MAPPED, DUPLICATE (the field was taken by an earlier column)
    or UNMAPPED; header cells that normalise to nothing are dropped.
    """
    cells = headers.select(
        "import_id", F.posexplode("headers").alias("position", "header")
    ).withColumn("alias", normalize_header(F.col("header")))
    matched = cells.filter(F.col("alias") != "").join(aliases, "alias", "left")
    first = Window.partitionBy("import_id", "field").orderBy("position")
    return (
        matched.withColumn("nth", F.row_number().over(first))
        .withColumn(
            "status",
            F.when(F.col("field").isNull(), "UNMAPPED")
            .when(F.col("nth") == 1, "MAPPED")
            .otherwise("DUPLICATE"),
        )
        .select(
            "import_id",
            "position",
            F.trim("header").alias("header"),
            "field",
            "status",
            "scale",
            "percent_points",
            "currency",
        )
    )


def missing_required(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(import_id, field)`` of required fields no header provides."""
    wanted = headers.select(
        "import_id", F.explode(F.array(*[F.lit(f) for f in REQUIRED_FIELDS])).alias("field")
    )
    have = mapping.filter(F.col("status") == "MAPPED").select("import_id", "field")
    return wanted.join(have, ["import_id", "field"], "left_anti")


def import_profile(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per file: where each field sits, its unit, and the unmapped headers."""
    mapped = F.col("status") == "MAPPED"
    profile = mapping.groupBy("import_id").agg(
        F.map_from_entries(
            F.collect_list(F.when(mapped, F.struct("field", "position")))
        ).alias("at"),
        F.map_from_entries(
            F.collect_list(
                F.when(
                    mapped,
                    F.struct(
                        F.col("field"), F.struct("scale", "percent_points", "currency").alias("u")
                    ),
                )
            )
        ).alias("units"),
        F.collect_set(F.when(F.col("status") == "UNMAPPED", F.col("header"))).alias("unmapped"),
    )
    return headers.select("import_id", "headers").join(profile, "import_id", "left")


def raw_map(headers: Column, cells: Column) -> Column:
    """Header -> raw cell for every column; nameless columns become ``column_N``."""

    def named(i: Column) -> Column:
        header = F.try_element_at(headers, i + 1)
        return F.when(F.coalesce(header, F.lit("")) != "", header).otherwise(
            F.concat(F.lit("column_"), (i + 1).cast("string"))
        )

    def kept(names: Column) -> Column:
        # A repeated header keeps its last cell, like assigning into a dictionary.
        last = F.filter(
            F.arrays_zip(names.alias("k"), cells.alias("v")),
            lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["k"]),
        )
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))

    # Bound once a row: every cell looks at the names of those after it.
    return let(F.transform(cells, lambda _, i: named(i)), kept)


# Profiles of a few kilobytes per file: at most some tens of megabytes in memory.
BROADCAST_FILES = 10_000


def _small(profile: DataFrame) -> DataFrame:
    """The per-file table, broadcast when there are few files, else joined as it is.

    Without this a short export may itself be taken for the small side, and all
    parsing would follow the handful of profile rows into one task.
    """
    stored = materialize(profile, "import-profile")
    few = stored.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    return F.broadcast(stored) if few else stored


def normalize_rows(rows: DataFrame, profile: DataFrame, default_date: str | Column) -> DataFrame:
    """Typed, validated form of ``rows(import_id, row_number, cells array<string>)``.

    A row without a channel name is rejected; any other bad cell costs only
    itself: NULL plus a warning. Everything is one projection over a join with
    the per-file profile.
    """
    joined = rows.join(_small(profile), "import_id")
    fallback = default_date if isinstance(default_date, Column) else F.lit(default_date).cast("date")

    def cell(field: str) -> Column:
        return F.get(F.col("cells"), F.col("at")[field])

    def unit(field: str, name: str) -> Column:
        return F.col("units")[field][name]

    scale = lambda field: F.coalesce(unit(field, "scale"), F.lit(1))
    parsed = joined.select(
        "import_id",
        "row_number",
        raw_map(F.col("headers"), F.col("cells")).alias("raw"),
        "unmapped",
        F.col("at").isNotNull().alias("_mapped"),
        F.col("at")["snapshot_date"].isNotNull().alias("_has_date"),
        clean_text(cell("channel_name")).alias("channel_name"),
        normalize_url(cell("channel_url")).alias("_url"),
        F.when(looks_like_handle(cell("channel_url")), normalize_handle(cell("channel_url"))).alias(
            "handle"
        ),
        clean_text(cell("channel_external_id")).alias("external_id"),
        cell("platform").alias("_platform"),
        clean_text(cell("category")).alias("category"),
        clean_text(cell("region")).alias("region"),
        clean_text(cell("currency")).alias("_currency"),
        parse_int(cell("subscribers"), scale("subscribers")).alias("_subscribers"),
        parse_int(cell("predicted_views"), scale("predicted_views")).alias("_predicted_views"),
        parse_decimal(cell("cpv")).alias("_cpv"),
        scale("cpv").alias("_cpv_scale"),
        parse_percent(
            cell("err"), F.coalesce(unit("err", "percent_points"), F.lit(False))
        ).alias("_err"),
        parse_money(cell("campaign_price")).alias("_price"),
        scale("campaign_price").alias("_price_scale"),
        F.coalesce(unit("campaign_price", "currency"), unit("cpv", "currency")).alias(
            "_header_currency"
        ),
        parse_date(cell("snapshot_date")).alias("_date"),
    )

    def warn(prefix: str, message: Column) -> Column:
        return F.concat(F.lit(f"{prefix}: "), message)

    typed = parsed.select(
        "*",
        F.col("_url.value").alias("channel_url"),
        detect_platform(F.col("_platform"), F.col("_url.value")).alias("platform"),
        F.col("_subscribers.value").alias("_s"),
        F.col("_predicted_views.value").alias("_v"),
        (F.col("_cpv.value").try_cast("decimal(26,9)") * F.col("_cpv_scale").cast("decimal(6,0)"))
        .try_cast("decimal(16,6)")
        .alias("_c"),
        (F.col("_price.value").try_cast("decimal(26,9)") * F.col("_price_scale").cast("decimal(6,0)"))
        .try_cast("decimal(18,2)")
        .alias("_p"),
        F.col("_err.value").try_cast("decimal(10,6)").alias("err"),
        # Currency: own cell, then the price cell, then the price and CPV headers.
        F.when(
            F.col("_price.error").isNull(),
            F.coalesce("_currency", "_price.currency", "_header_currency"),
        ).alias("currency"),
        F.array_compact(
            F.array(
                F.when(
                    F.col("handle").isNotNull(),
                    F.concat(
                        F.lit("channel_url: treated as handle '"), F.col("handle"), F.lit("'")
                    ),
                ).otherwise(warn("channel_url", F.col("_url.error"))),
                warn("subscribers", F.col("_subscribers.error")),
                warn("predicted_views", F.col("_predicted_views.error")),
                warn("cpv", F.col("_cpv.error")),
                warn("err", F.col("_err.error")),
                warn("err", F.col("_err.warning")),
                F.when(
                    F.col("_err.value") > ERR_SUSPICIOUS,
                    F.concat(
                        F.lit("err: suspiciously high value "),
                        F.regexp_replace(F.col("_err.value").cast("string"), r"\.?0+$", ""),
                    ),
                ),
                warn("campaign_price", F.col("_price.error")),
                warn("snapshot_date", F.col("_date.error")),
            )
        ).alias("_cell_warnings"),
    )

    def discarded(name: str, value: str) -> Column:
        return F.when(
            F.col(value) < 0,
            F.concat(
                F.lit(f"{name}: negative value "), F.col(value).cast("string"), F.lit(" discarded")
            ),
        )

    # The default-date warning appears only when nothing else was said so far.
    defaulted = F.when(
        F.col("_date.value").isNull() & F.col("_has_date") & (F.size("_cell_warnings") == 0),
        F.lit("snapshot_date: empty, using the import default"),
    )
    keep = lambda value: F.when(F.col(value) >= 0, F.col(value))
    return typed.select(
        "import_id",
        "row_number",
        "platform",
        build_dedupe_key(
            F.col("external_id"), F.col("handle"), F.col("channel_url"), F.col("channel_name")
        ).alias("dedupe_key"),
        "external_id",
        "handle",
        "channel_name",
        "channel_url",
        "category",
        "region",
        F.coalesce("_date.value", fallback).alias("snapshot_date"),
        keep("_s").alias("subscribers"),
        "err",
        keep("_v").alias("predicted_views"),
        keep("_c").alias("cpv"),
        keep("_p").alias("campaign_price"),
        "currency",
        "raw",
        F.map_filter(
            "raw",
            lambda k, v: F.array_contains(F.coalesce("unmapped", F.array().cast("array<string>")), k)
            & v.isNotNull(),
        ).alias("extra"),
        F.array_compact(
            F.array(F.when(F.col("channel_name").isNull(), F.lit("channel_name: value is empty")))
        ).alias("errors"),
        F.concat(
            "_cell_warnings",
            F.array_compact(
                F.array(
                    defaulted,
                    discarded("subscribers", "_s"),
                    discarded("predicted_views", "_v"),
                    discarded("cpv", "_c"),
                    discarded("campaign_price", "_p"),
                )
            ),
        ).alias("warnings"),
    )


def is_valid(errors: Column | str = "errors") -> Column:
    return F.size(errors) == 0


def resolve_niches(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """All niches after the import: ``(niche_id, slug, name)``.

    Labels meet by slug; a stored niche keeps its name, among new labels the
    one of the first row wins.
    """
    fresh = (
        rows.filter(is_valid() & F.col("category").isNotNull())
        .withColumn("slug", slugify(F.col("category")))
        .groupBy("slug")
        .agg(F.min_by("category", F.struct("import_id", "row_number")).alias("name"))
        .join(existing.select("slug"), "slug", "left_anti")
        .select(F.sha2(F.concat(F.lit("niche:"), F.col("slug")), 256).alias("niche_id"), "slug", "name")
    )
    return existing.select("niche_id", "slug", "name").unionByName(fresh)


def channel_id(platform: Column, dedupe_key: Column) -> Column:
    return F.sha2(F.concat_ws("|", platform, dedupe_key), 256)


def resolve_channels(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """New version of the channel table after the valid ``rows``.

    Identity is (platform, dedupe_key). The first row names a new channel and
    the name never changes; URL, external id and niche are filled when missing,
    from the earliest row that has them; the seen interval widens.
    """
    order = F.struct("import_id", "row_number")

    def earliest(name: str) -> Column:
        value = F.col(name)
        return F.min_by(value, F.when(value.isNotNull(), order))

    incoming = (
        rows.filter(is_valid() & F.col("dedupe_key").isNotNull())
        .withColumn("niche_slug", F.when(F.col("category").isNotNull(), slugify(F.col("category"))))
        .groupBy("platform", "dedupe_key")
        .agg(
            F.min_by("channel_name", order).alias("new_name"),
            earliest("channel_url").alias("new_url"),
            earliest("external_id").alias("new_external"),
            earliest("niche_slug").alias("new_niche"),
            F.min("snapshot_date").alias("new_first"),
            F.max("snapshot_date").alias("new_last"),
        )
    )
    return existing.join(incoming, ["platform", "dedupe_key"], "full").select(
        channel_id(F.col("platform"), F.col("dedupe_key")).alias("channel_id"),
        "platform",
        "dedupe_key",
        F.coalesce("channel_name", "new_name").alias("channel_name"),
        F.coalesce(F.nullif("channel_url", F.lit("")), "new_url").alias("channel_url"),
        F.coalesce(F.nullif("external_id", F.lit("")), "new_external").alias("external_id"),
        F.coalesce("niche_slug", "new_niche").alias("niche_slug"),
        F.least("first_seen_date", "new_first").alias("first_seen_date"),
        F.greatest("last_seen_date", "new_last").alias("last_seen_date"),
    )


def mark_snapshots(rows: DataFrame) -> DataFrame:
    """Add ``is_snapshot`` and the duplicate warning.

    Within one file the first row of a (channel, date) makes the snapshot;
    later ones keep only their audit row. The first row is found by an
    aggregate, so a channel repeated through a whole file costs one record per
    task.
    """
    keys = ["import_id", "platform", "dedupe_key", "snapshot_date"]
    usable = is_valid() & F.col("dedupe_key").isNotNull()
    first = rows.filter(usable).groupBy(*keys).agg(F.min("row_number").alias("_first"))
    marked = rows.join(first, keys, "left")
    keeper = usable & (F.col("row_number") == F.col("_first"))
    repeat = usable & (F.col("row_number") != F.col("_first"))
    return (
        marked.withColumn("is_snapshot", F.coalesce(keeper, F.lit(False)))
        .withColumn(
            "warnings",
            F.when(repeat, F.array_append("warnings", F.lit(DUPLICATE_WARNING))).otherwise(
                F.col("warnings")
            ),
        )
        .withColumn("is_repeat", F.coalesce(repeat, F.lit(False)))
        .drop("_first")
    )


def snapshots(marked: DataFrame, created_at: str | Column) -> DataFrame:
    """Append-only snapshot rows of the import."""
    moment = created_at if isinstance(created_at, Column) else F.lit(created_at).cast("timestamp")
    return marked.filter("is_snapshot").select(
        channel_id(F.col("platform"), F.col("dedupe_key")).alias("channel_id"),
        "import_id",
        "snapshot_date",
        moment.alias("created_at"),
        "subscribers",
        "err",
        "predicted_views",
        "cpv",
        "campaign_price",
        "currency",
        "region",
        "extra",
    )


def audit_rows(marked: DataFrame) -> DataFrame:
    """One audit row per source row, valid or not, with raw and normalised values."""
    fields = [
        "channel_name", "channel_url", "external_id", "handle", "platform", "dedupe_key",
        "category", "region", "snapshot_date", "subscribers", "err", "predicted_views", "cpv",
        "campaign_price", "currency",
    ]
    linked = is_valid() & F.col("dedupe_key").isNotNull()
    return marked.select(
        "import_id",
        "row_number",
        F.when(is_valid(), "VALID").otherwise("REJECTED").alias("status"),
        F.col("raw").alias("raw_data"),
        F.struct(*fields).alias("normalized_data"),
        F.when(linked, channel_id(F.col("platform"), F.col("dedupe_key"))).alias("channel_id"),
        "errors",
        "warnings",
    )


def new_files(files: DataFrame, imports: DataFrame, force: bool = False) -> DataFrame:
    """Files whose checksum no *completed* import has; ``force`` keeps all."""
    if force:
        return files
    done = imports.filter(F.col("status").isin(*COMPLETED_IMPORTS)).select("checksum")
    return files.join(done, "checksum", "left_anti")


def fatal_files(headers: DataFrame, missing: DataFrame, rows: DataFrame) -> DataFrame:
    """Why a file cannot be imported at all; NULL reason means it can.

    ``headers(import_id, headers)`` carries NULL headers for files without any
    header row.
    """
    absent = missing.groupBy("import_id").agg(
        F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("absent")
    )
    counts = rows.groupBy("import_id").agg(F.count("*").alias("data_rows"))
    reason = (
        F.when(F.col("headers").isNull(), F.lit("no header row found"))
        .when(
            F.col("absent").isNotNull(),
            F.concat(F.lit("required columns not found: "), F.col("absent")),
        )
        .when(
            F.coalesce("data_rows", F.lit(0)) == 0,
            F.lit("file contains a header but no data rows"),
        )
    )
    return (
        headers.join(absent, "import_id", "left")
        .join(counts, "import_id", "left")
        .select("import_id", reason.alias("reason"))
    )


def split_files(headers: DataFrame, missing: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gate before any row is read: ``(rows of usable files, (import_id, reason) of failed files)``.

    A failed file writes no audit rows, channels or snapshots; its reason goes to the outcome.
    """
    failed = fatal_files(headers, missing, rows).filter(F.col("reason").isNotNull())
    return rows.join(failed.select("import_id"), "import_id", "left_anti"), failed


def import_outcome(
    marked: DataFrame, existing_channels: DataFrame, failed: DataFrame | None = None
) -> DataFrame:
    """Counts and final status per import; files that failed at the gate have zeros and the reason."""
    keyed = is_valid() & F.col("dedupe_key").isNotNull()
    created = (
        marked.filter(keyed)
        .groupBy("platform", "dedupe_key")
        .agg(F.min("import_id").alias("import_id"))
        .join(existing_channels.select("platform", "dedupe_key"), ["platform", "dedupe_key"], "left_anti")
        .groupBy("import_id")
        .agg(F.count("*").alias("channels_created"))
    )
    totals = marked.groupBy("import_id").agg(
        F.count("*").alias("row_count"),
        F.count_if(is_valid()).alias("valid_row_count"),
        F.count_if(~is_valid()).alias("rejected_row_count"),
        F.sum(F.size("warnings")).alias("warning_count"),
        F.count_if("is_snapshot").alias("snapshots_created"),
        F.count_if("is_repeat").alias("duplicates_in_file"),
    )
    status = (
        F.when(F.col("valid_row_count") == 0, "FAILED")
        .when(F.col("rejected_row_count") > 0, "PARTIAL")
        .otherwise("SUCCESS")
    )
    outcome = (
        totals.join(created, "import_id", "left")
        .withColumn("channels_created", F.coalesce("channels_created", F.lit(0)))
        .withColumn("status", status)
        .withColumn(
            "error_message", F.when(F.col("status") == "FAILED", F.lit("no valid rows in file"))
        )
    )
    if failed is None:
        return outcome
    stated = {"import_id": F.col("import_id"), "status": F.lit("FAILED"), "error_message": F.col("reason")}
    return outcome.unionByName(
        failed.select(*[stated.get(c, F.lit(0).cast("bigint")).alias(c) for c in outcome.columns])
    )


def warning_samples(marked: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` warnings of every import in row order (a report, hence the limit)."""
    flat = marked.select("import_id", "row_number", F.posexplode("warnings").alias("nth", "warning"))
    order = Window.partitionBy("import_id").orderBy("row_number", "nth")
    return (
        flat.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select(
            "import_id",
            "position",
            F.concat(F.lit("row "), F.col("row_number").cast("string"), F.lit(": "), "warning").alias(
                "sample"
            ),
        )
    )


def recent_imports(imports: DataFrame, limit: int = 20) -> DataFrame:
    return imports.orderBy(F.desc("created_at"), "import_id").limit(limit)


def rows_by_status(audit: DataFrame) -> DataFrame:
    return audit.groupBy("import_id", "status").agg(F.count("*").alias("row_count"))


def sample_rows(
    audit: DataFrame, status: str | None = None, with_warnings: bool = False, limit: int = 10
) -> DataFrame:
    """First rows per import for inspection, optionally by status or with warnings."""
    if status is not None:
        audit = audit.filter(F.col("status") == status)
    if with_warnings:
        audit = audit.filter(F.size("warnings") > 0)
    order = Window.partitionBy("import_id").orderBy("row_number")
    return (
        audit.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
    )


