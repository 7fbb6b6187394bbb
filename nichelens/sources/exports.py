"""Delimited channel exports of unknown encoding, delimiter and header position.

Files are read line by line across the cluster; only a profile of the first
lines of each file (encoding, delimiter, header) is computed per file, and the
rest is one projection over a join with that profile. A quoted cell may run
over line breaks, which are dropped: what a line does to an open quote is
computed line by line, composed per block of lines and over the blocks of a
file, and lines are joined into records where a quote stays open.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichelens.functions.normalize import is_blank, strip_ws
from nichelens.session import materialize

# What is tried, and how far a header is looked for.
ENCODINGS = ("utf-8", "windows-1251")
DELIMITERS = (";", ",", "\t")
HEADER_SCAN_ROWS = 20
MIN_HEADER_CELLS = 2
DIALECT_CHARS = 8192
#: Ties of the dialect rule go to the first of these.
DIALECT_ORDER = (",", "\t", ";")
#: Share of the lines that must agree on how often a delimiter stands in them.
DIALECT_AGREEMENT = 0.9
#: A cell may have so many characters; a file with a longer one is unusable.
CELL_CHARS = 131_072
#: What ends a line beside the line feed, in decoded text.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

#: Lines whose quotes are looked at together.
BLOCK_LINES = 65_536
#: Bytes that a file is read in for its checksum.
CHUNK_BYTES = 1 << 20


def _chunks(path: str, size: int):
    """Bytes of one file, ``size`` at a time, from the file system that its address names."""
    from pyarrow import fs

    local = path.startswith(("file:", "/"))
    # Spark gives names as they are, not as escaped addresses.
    store, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as stream:
        while chunk := stream.read(size):
            yield chunk


def sha256_files(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``(path, checksum, file_size)`` of every file under ``path``.

    Spark lists the files without reading them; a task then reads its files one
    after another, ``chunk`` bytes at a time, so that a file of any size needs
    no more memory than that. ``file_size`` is the number of bytes read. A file
    without bytes has no row, as Spark's readers pass it over.
    """

    def digest(parts):
        for part in parts:
            rows = []
            for name in part["path"]:
                state, size = hashlib.sha256(), 0
                for piece in _chunks(name, chunk):
                    state.update(piece)
                    size += len(piece)
                rows.append((name, state.hexdigest(), size))
            yield pd.DataFrame(rows, columns=["path", "checksum", "file_size"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    # Files come packed by their sizes; each becomes a piece of work of its own.
    files = files.repartition(F.col("path")).select("path")
    return files.mapInPandas(digest, "path string, checksum string, file_size long")


def _without_return(line: Column) -> Column:
    """Drop a final carriage return bytewise: the line may not be valid UTF-8."""
    size = F.octet_length(line)
    last = F.substring(line, size, F.lit(1))
    return F.when(last == F.lit(bytearray(b"\r")), F.substring(line, F.lit(1), size - 1)).otherwise(
        line
    )


def read_lines(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """``(file, line_no, bytes)``: raw lines with 1-based numbers per file.

    A line's number is its offset inside its file split plus the lines of the
    splits before it, so large files are numbered without a per-file sort. With
    ``in_parts`` a folder is one file, landed in parts that follow by name; parts
    end with their lines.
    """
    name, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    file, block = name, start
    if in_parts:
        file, part = F.regexp_replace(name, "/[^/]*$", ""), F.regexp_extract(name, "([^/]*)$", 1)
        block = F.struct(part.alias("part"), start.alias("start"))
    raw = spark.read.text(path, lineSep="\n").select(
        file.alias("file"),
        block.alias("block"),
        F.monotonically_increasing_id().alias("turn"),
        _without_return(F.col("value").cast("binary")).alias("bytes"),
    )
    lines = materialize(raw, "export-lines")
    blocks = (
        lines.groupBy("file", "block")
        .agg(F.min("turn").alias("start"), F.count("*").alias("size"))
        .withColumn(
            "before",
            F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size"),
        )
    )
    number = F.col("before") + F.col("turn") - F.col("start") + 1
    return lines.join(blocks, ["file", "block"]).select("file", number.alias("line_no"), "bytes")


# Windows-1251 above ASCII, by rule; the one unassigned byte makes a file undecodable.
_HIGH_BYTES = [b for b in range(128, 256) if b != 0x98]
_LATIN = "".join(map(chr, _HIGH_BYTES))
_CYRILLIC = bytes(_HIGH_BYTES).decode("cp1251")


def detect_encoding(lines: DataFrame) -> DataFrame:
    """``(file, encoding)``: UTF-8 when every line is valid, else Windows-1251, else NULL."""
    valid = F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string")))
    unassigned = F.bool_or(F.contains("bytes", F.lit(bytearray(b"\x98"))))
    return lines.groupBy("file").agg(
        F.when(valid, ENCODINGS[0]).when(~unassigned, ENCODINGS[1]).alias("encoding")
    )


def decode_lines(lines: DataFrame, encodings: DataFrame) -> DataFrame:
    """``(file, line_no, value)`` as text, without a byte-order mark.

    Spark decodes Latin-1 but not Windows-1251; one is the other after a
    character-by-character translation. Undecodable files have no lines.
    """
    encodings = encodings.filter(F.col("encoding").isNotNull())
    text = F.when(
        F.col("encoding") == ENCODINGS[0], F.col("bytes").cast("string")
    ).otherwise(F.translate(F.decode("bytes", "iso-8859-1"), _LATIN, _CYRILLIC))
    clean = F.when(F.col("line_no") == 1, F.ltrim(text, F.lit("\ufeff"))).otherwise(text)
    return lines.join(encodings, "file").select("file", "line_no", clean.alias("value"))


def _occurrences(text: Column, delimiter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(delimiter)))


def detect_delimiter(lines: DataFrame) -> DataFrame:
    """``(file, delimiter)`` from the leading lines.

    The delimiter present in most lines wins, then the more frequent one, then
    the order of :data:`DELIMITERS`.
    """
    head = lines.filter(F.col("line_no") <= HEADER_SCAN_ROWS)
    counts = head.groupBy("file").agg(
        *[
            F.struct(
                F.count_if(_occurrences(F.col("value"), d) > 0).alias("lines"),
                F.sum(_occurrences(F.col("value"), d)).alias("total"),
            ).alias(f"d{i}")
            for i, d in enumerate(DELIMITERS)
        ]
    )
    ranked = F.array(
        *[
            F.struct(
                F.col(f"d{i}.lines").alias("lines"),
                F.col(f"d{i}.total").alias("total"),
                F.lit(-i).alias("turn"),
                F.lit(d).alias("delimiter"),
            )
            for i, d in enumerate(DELIMITERS)
        ]
    )
    return counts.select("file", F.array_max(ranked)["delimiter"].alias("delimiter"))


def physical_lines(lines: DataFrame) -> DataFrame:
    """``(file, line_no, part_no, value)``: decoded lines cut at the breaks other than the line feed."""
    parts = F.posexplode(F.split("value", f"[{OTHER_BREAKS}]"))
    whole = F.col("value").rlike(f"[{OTHER_BREAKS}]")
    cut = lines.filter(whole).select("file", "line_no", parts.alias("part_no", "value"))
    return lines.filter(~whole).select("file", "line_no", F.lit(0).alias("part_no"), "value").unionByName(cut)


def dialect(lines: DataFrame) -> DataFrame:
    """``(file, delimiter)`` from the first ``DIALECT_CHARS`` characters of decoded lines.

    Where quoted cells stand beside delimiters, the delimiter beside most of them
    wins. Otherwise quoted text is left out and a table of lines by number of
    delimiters decides: the delimiter that the largest part of the non-empty
    lines has equally often wins, if at least ``DIALECT_AGREEMENT`` of them
    agree. Otherwise it is the most frequent one of the first line. Ties go by
    ``DIALECT_ORDER``, on the first line by ``DELIMITERS``. Only lines that
    begin within the sample are looked at, and at most as many as it has characters.
    """
    head = lines.filter(F.col("line_no") <= DIALECT_CHARS)
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("value") + 1).over(upto), F.lit(0))
    sample = (
        head.withColumn("before", before)
        .filter(F.col("before") < DIALECT_CHARS)
        .select("file", "line_no", F.substring("value", F.lit(1), F.lit(DIALECT_CHARS) - F.col("before")).alias("value"))
    )
    text = sample.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("held"))
    text = text.select("file", F.array_join(F.transform("held", lambda x: x["value"]), "\n").alias("text"))

    def bordering(d: str) -> Column:
        quoted = rf'(?:(?<=^|\n|{d}) ?"[^"]*+(?:""[^"]*+)*+"(?={d}))|(?:(?<={d}) ?"[^"]*+(?:""[^"]*+)*+"(?=\n|$))'
        return F.regexp_count("text", F.lit(quoted))

    bare = F.split(F.regexp_replace("text", r'"[^"]*+(?:""[^"]*+)*+"?', "q"), "\n")
    bare = F.filter(bare, lambda x: x != "")
    found = text.select(
        "file",
        F.array(*[F.struct(bordering(d).alias("cells"), F.lit(-i).alias("turn"), F.lit(d).alias("delimiter")) for i, d in enumerate(DIALECT_ORDER)]).alias("beside"),
        F.size(bare).alias("n"),
        F.explode_outer(bare).alias("line"),
        F.substring_index("text", "\n", 1).alias("first"),
    )
    counts = F.array(*[F.struct(F.lit(-i).alias("turn"), F.lit(d).alias("delimiter"), _occurrences(F.col("line"), d).alias("times")) for i, d in enumerate(DIALECT_ORDER)])
    table = found.select("file", "n", F.explode(counts).alias("c")).filter("c.times > 0").groupBy("file", "n", "c").count()
    best = table.groupBy("file").agg(F.max(F.struct(F.col("count").alias("lines"), "c.turn", "c.times", "c.delimiter", "n")).alias("best"))
    profile = found.groupBy("file").agg(F.first("beside").alias("beside"), F.first("first").alias("first"))
    beside = F.array_max("beside")
    agreed = F.when(F.col("best.lines") >= F.col("best.n") * DIALECT_AGREEMENT, F.col("best.delimiter"))
    first = F.array_max(F.array(*[F.struct(_occurrences(F.col("first"), d).alias("times"), F.lit(-i).alias("turn"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)]))
    chosen = F.when(beside["cells"] > 0, beside["delimiter"]).otherwise(F.coalesce(agreed, first["delimiter"]))
    return profile.join(best, "file", "left").select("file", chosen.alias("delimiter"))


def _cell(mark: str) -> tuple[str, str]:
    """Patterns of an opened and not closed quoted cell, and of a whole cell with its delimiter."""
    opened = r'"[^"]*+(?:""[^"]*+)*+'
    return opened, rf'(?:{opened}"[^{mark}]*+|[^"{mark}][^{mark}]*+|){mark}'


def _by_delimiter(delimiter: Column, expression) -> Column:
    chosen = F
    for d in DELIMITERS:
        chosen = chosen.when(delimiter == d, expression("\\t" if d == "\t" else d))
    return chosen


def open_after(value: Column, delimiter: Column, inside: bool) -> Column:
    """Whether a quote is open after the line, if one was (``inside``) or was not open before it.

    Only a quote that begins a cell opens one; what follows a closing quote up
    to the delimiter belongs to the cell.
    """

    def pattern(mark: str) -> Column:
        opened, cell = _cell(mark)
        if inside:
            return value.rlike(rf'^[^"]*+(?:""[^"]*+)*+(?:$|"[^{mark}]*+{mark}(?:{cell})*+{opened}$)')
        return value.rlike(rf"^(?:{cell})*+{opened}$")

    return F.coalesce(_by_delimiter(delimiter, pattern), F.lit(False))


def quoted_records(lines: DataFrame, block_lines: int = BLOCK_LINES, cell_chars: int | None = CELL_CHARS) -> tuple[DataFrame, DataFrame]:
    """Records of ``lines(file, line_no, part_no, value, delimiter)``, and files that have none.

    ``(file, line_no, value, delimiter, open)``, where ``line_no`` numbers the
    records of a file and ``open`` tells that a quote is open at its end, and
    ``(file, reason)`` of files with a record that runs over lines and has more
    than sixteen times ``cell_chars`` characters.

    A line is a function of one bit, whether a quote is open: it sets the bit,
    keeps it or flips it. A block of lines is such a function too, made of what
    the last setting line leaves and the flips after it; the bit at the start of
    each block follows from the blocks before it. Windows see one block at a
    time, and lines of one record meet only where it has several.
    """
    block = F.floor((F.col("line_no") - 1) / block_lines)
    told = lines.withColumn("block", block).select(
        "file", "block", "line_no", "part_no", "value", "delimiter",
        open_after(F.col("value"), F.col("delimiter"), False).alias("fresh"), open_after(F.col("value"), F.col("delimiter"), True).alias("within"),
    )
    inside = Window.partitionBy("file", "block").orderBy("line_no", "part_no")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets, flips = F.col("fresh") == F.col("within"), (F.col("fresh") & ~F.col("within")).cast("int")

    def composed(frame: DataFrame, sets: Column, value: Column, flips: Column, window) -> DataFrame:
        """Adds ``known`` and ``bit``: the function of all rows so far sets the bit, or flips it if ``bit``."""
        frame = frame.withColumn("flips", F.sum(flips).over(window))
        mark = F.last(F.when(sets, F.struct(value.alias("value"), F.col("flips").alias("flips"))), ignorenulls=True)
        frame = frame.withColumn("mark", mark.over(window))
        turned = (F.col("flips") - F.coalesce("mark.flips", F.lit(0))) % 2 == 1
        bit = F.coalesce("mark.value", F.lit(False)) != turned
        return frame.withColumn("known", F.col("mark").isNotNull()).withColumn("bit", bit).drop("mark", "flips")

    told = composed(told, sets, F.col("fresh"), flips, running)
    told = told.withColumn("was_known", F.coalesce(F.lag("known").over(inside), F.lit(False)))
    told = told.withColumn("was_bit", F.coalesce(F.lag("bit").over(inside), F.lit(False)))
    # Records that begin so far, if no quote, or one, is open at the start of the block.
    begins = {0: ~F.col("was_bit"), 1: F.col("was_known") != F.col("was_bit")}
    for k, start in begins.items():
        told = told.withColumn(f"begun{k}", F.sum(start.cast("long")).over(running))
    told = materialize(told, "quoted-lines")
    place = F.struct("line_no", "part_no")
    blocks = told.groupBy("file", "block").agg(
        F.max(F.struct(place.alias("place"), "known", "bit", "begun0", "begun1")).alias("end")
    ).select("file", "block", "end.known", "end.bit", "end.begun0", "end.begun1")
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumnsRenamed({"known": "sets", "bit": "value"})
    # Of nothing before it, a block's own row must not count: the window ends one row earlier.
    blocks = composed(blocks, F.col("sets"), F.col("value"), (~F.col("sets") & F.col("value")).cast("int"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = F.coalesce(F.lag("bit").over(Window.partitionBy("file").orderBy("block")), F.lit(False))
    blocks = blocks.withColumn("open", open_)
    begun = F.when(F.col("open"), F.col("begun1")).otherwise(F.col("begun0"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum(begun).over(over), F.lit(0).cast("long")))
    placed = told.join(blocks.select("file", "block", "open", "before"), ["file", "block"])
    after = F.when(F.col("known"), F.col("bit")).otherwise(F.col("open") != F.col("bit"))
    before = F.when(F.col("was_known"), F.col("was_bit")).otherwise(F.col("open") != F.col("was_bit"))
    number = F.col("before") + F.when(F.col("open"), F.col("begun1")).otherwise(F.col("begun0"))
    placed = placed.select(
        "file", number.alias("record"), "line_no", "part_no", "value", "delimiter", after.alias("after"), (~before & ~after).alias("alone")
    )
    alone = placed.filter("alone").select("file", F.col("record").alias("line_no"), "value", "delimiter", F.lit(False).alias("open"))
    parts = placed.filter("NOT alone")
    broken = None
    if cell_chars is not None:
        sizes = parts.groupBy("file", "record").agg(F.sum(F.length("value")).alias("chars"))
        broken = sizes.filter(F.col("chars") > 16 * cell_chars).select("file", F.lit("record too long").alias("reason")).distinct()
        parts = parts.join(broken.select("file"), "file", "left_anti")
        alone = alone.join(broken.select("file"), "file", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "part_no", "value")))
    joined = parts.groupBy("file", "record", "delimiter").agg(
        ordered.alias("held"), F.max_by("after", place).alias("open")
    ).select(
        "file", F.col("record").alias("line_no"), F.array_join(F.transform("held", lambda x: x["value"]), "").alias("value"), "delimiter", "open"
    )
    if broken is None:
        broken = lines.sparkSession.createDataFrame([], "file string, reason string")
    return alone.unionByName(joined), broken


def record_cells(value: Column, delimiter: Column, open_: Column) -> Column:
    """Cells of one record; an empty one has none. A quote that is open at the end is closed there."""
    ended = F.concat(value, F.when(open_, F.lit('"')).otherwise(F.lit("")), delimiter)

    def cells(mark: str) -> Column:
        opened, _ = _cell(mark)
        whole = rf'({opened}"[^{mark}]*+|[^"{mark}][^{mark}]*+|){mark}'
        return F.regexp_extract_all(ended, F.lit(whole), F.lit(1))

    quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'
    plain = F.transform(
        _by_delimiter(delimiter, cells),
        lambda c: F.when(
            F.startswith(c, F.lit('"')),
            F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2)),
        ).otherwise(c),
    )
    return F.when(value == "", F.array().cast("array<string>")).otherwise(plain)


def split_cells(value: Column, delimiter: Column) -> Column:
    """Cells of one delimited line, honouring double quotes; an empty line has none."""
    split = F
    for d in DELIMITERS:
        mark = "\\t" if d == "\t" else d
        found = F.regexp_extract_all(
            F.concat(value, F.lit(d)), F.lit(rf'((?:"(?:[^"]|"")*")|[^{mark}]*){mark}'), F.lit(1)
        )
        split = split.when(delimiter == d, found)
    cells = F.transform(
        split,
        lambda cell: F.when(
            cell.rlike(r'^"(?s).*"$'),
            F.replace(F.substring(cell, 2, F.length(cell) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(cell),
    )
    return F.when(value == "", F.array().cast("array<string>")).otherwise(cells)


def parse_lines(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """``(file, line_no, cells)``."""
    return lines.join(delimiters, "file").select(
        "file", "line_no", split_cells(F.col("value"), F.col("delimiter")).alias("cells")
    )


def width(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: ~is_blank(c)))


def find_header(rows: DataFrame) -> DataFrame:
    """``(file, header_line, headers)``: the widest of the first rows, earliest on ties.

    Files whose widest row has fewer than two filled cells get NULLs.
    """
    window = rows.filter(F.col("line_no") <= HEADER_SCAN_ROWS).withColumn("w", width(F.col("cells")))
    best = window.groupBy("file").agg(
        F.max("w").alias("w"),
        F.max_by(F.struct("line_no", "cells"), F.struct("w", -F.col("line_no"))).alias("best"),
    )
    enough = F.col("w") >= MIN_HEADER_CELLS
    names = F.transform("best.cells", lambda c: F.coalesce(strip_ws(c), F.lit("")))
    return best.select(
        "file",
        F.when(enough, F.col("best.line_no")).alias("header_line"),
        F.when(enough, names).alias("headers"),
    )


def data_rows(rows: DataFrame, header: DataFrame) -> DataFrame:
    """``(file, line_no, cells)`` below the header with at least one filled cell."""
    return (
        rows.join(header.select("file", "header_line"), "file")
        .filter((F.col("line_no") > F.col("header_line")) & (width(F.col("cells")) > 0))
        .select("file", "line_no", "cells")
    )


def parse_export(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header per file, data rows) of decoded ``lines(file, line_no, value)``."""
    parsed = parse_lines(lines, detect_delimiter(lines))
    header = find_header(parsed)
    return header, data_rows(parsed, header)


def read_export_csv(
    spark: SparkSession, path: str, block_lines: int = BLOCK_LINES, cell_chars: int | None = CELL_CHARS, in_parts: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(header per file, data rows) of all delimited files under ``path``.

    ``line_no`` numbers records, blank ones included. A file whose encoding is
    unknown, or with a cell of more than ``cell_chars`` characters, has no rows
    and its header is NULL. With ``in_parts`` each folder is one file.
    """
    lines = read_lines(spark, path, in_parts)
    encodings = detect_encoding(lines)
    decoded = decode_lines(lines, encodings)
    physical = physical_lines(decoded).join(dialect(decoded), "file")
    records, broken = quoted_records(physical, block_lines, cell_chars)
    cells = record_cells(F.col("value"), F.col("delimiter"), F.col("open"))
    parsed = materialize(records.select("file", "line_no", cells.alias("cells")), "export-records")
    if cell_chars is not None:
        long_cell = F.exists("cells", lambda c: F.length(c) > cell_chars)
        broken = broken.select("file").union(parsed.filter(long_cell).select("file")).distinct()
        parsed = parsed.join(broken, "file", "left_anti")
    header = find_header(parsed)
    every = lines.select("file").distinct().join(header, "file", "left")
    return every, data_rows(parsed, header)
