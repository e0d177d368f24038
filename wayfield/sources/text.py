"""Reader of semicolon-separated measurement exports with unknown preambles and headers.

The files are scanned once: their lines are written to the shared folder with the ids
and the numbers of cells that this scan gives them, and everything after reads that
table. A scan of text has no line numbers, and a second scan may be cut in other places,
so ids of two scans must never meet.

A table of one row for each file (encoding, header line, header, width, technology) is
computed first and stays a table. Only the distinct layouts, headers with their width,
come to the driver: as many as there are kinds of devices. Names, ambiguity and missing
fields are settled for layouts. The lines are then read in one pass: cells are cut by
``from_csv`` and picked by the positions that the file's layout gives each name of the
union.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import header_token, nr_state, parse_number, row_time_ms
from ..functions.shared import checkpointed, written
from ..operators.order import numbered

#: Header tokens that mean the same logical field (fixed values); the first group member found in a file counts.
FIELDS = {
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng", "long"),
    "frequency": ("nrarfcn", "earfcn", "frequency", "freq", "ssref"),
    "pci": ("pci",),
    "mcc": ("mcc",),
    "mnc": ("mnc",),
    "rsrp": ("sssrsrp", "ssrsrp", "nrssrsrp", "rsrp"),
    "sinr": ("ssssinr", "sssinr", "nrsssinr", "sinr"),
}
REQUIRED = ("latitude", "longitude", "frequency", "pci", "mcc", "mnc", "rsrp")
NR_NAMES = ("5gnr", "nr")
#: Fields of files with the second technology's states; a time is either of TIMES.
STATE_FIELDS = {"mcc": FIELDS["mcc"], "mnc": FIELDS["mnc"], "nr": NR_NAMES}
TIMES = (("utc",), ("date", "time"))
NR = "5G NR"
LOOK_AHEAD = 25
#: Cells of a header that is told by its width alone, and such cells below it in how many lines (fixed values).
WIDE, FOLLOWERS = 6, 2
#: Lines at a file's start in which its header is looked for first, and lines of a longer search handled together.
PREFIX, CHUNK = 1000, 50_000
SOURCE = "source_idx"
#: Rows of a table of files or blocks (of about 200 bytes) up to which it is broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class FileMeta:
    """A file, or a layout by the first file that has it."""

    path: str
    index: int
    utf8: bool
    header_line: int
    columns: tuple[str, ...]
    technology: str


@dataclass(frozen=True)
class Blocks:
    """The lines of the files as written (path, start, id, cells, valid, raw), and a small row for each block with its first id and number of lines."""

    table: DataFrame
    firsts: DataFrame
    small: bool

    def held(self, table: DataFrame) -> DataFrame:
        """A table of at most one row a block, broadcast if these are few."""
        return F.broadcast(table) if self.small else table


def blocks_of(spark: SparkSession, paths: list[str]) -> Blocks:
    """One scan of the text, written with its ids; ``cells`` is null for a blank line, ``valid`` tells UTF-8.

    A block's lines are read in order by one task, and only the attempt that is committed
    is written, so ids rise by one in each block of the table, wherever the scan was cut.
    """
    raw = F.col("value").cast("binary")
    # Semicolons and quotes are the same bytes in all encodings.
    plain = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "^ï»¿", "")
    n = F.when(F.trim(plain) != "", F.size(cells(F.regexp_replace(plain, '"[^"]*"', "q"))))
    scan = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"),
        n.alias("cells"), F.is_valid_utf8("value").alias("valid"), raw.alias("raw"),
    )
    table = written(scan, "lines")
    firsts = checkpointed(table.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n_lines"), F.bool_and("valid").alias("utf8")))
    return Blocks(table, firsts, firsts.count() <= BROADCAST_ROWS)


def lines(blocks: Blocks) -> DataFrame:
    """(path, line_no, cells, raw) of all lines; numbers rise in each file, from 0 by one in its first block.

    A line's number is where its block starts plus its place in the block, which no line of
    the next block reaches; so only one small row a block is gathered, never the lines.
    """
    rows = blocks.table.join(blocks.held(blocks.firsts), ["path", "start"])
    return rows.select("path", (F.col("start") + F.col("id") - F.col("first")).alias("line_no"), "cells", "raw")


def decoded(raw: Column, utf8: Column) -> Column:
    """Text of a line: UTF-8 where the whole file is, else Latin-1; without a byte-order mark."""
    text = F.when(utf8, F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def cells(text: Column) -> Column:
    """A line's cells as raw pieces, for recognising headers and counting."""
    return F.split(F.regexp_replace(text, ";+$", ""), ";")


def _is_header(text: Column) -> Column:
    tokens = F.transform(cells(text), lambda c: header_token(F.replace(c, F.lit('"'), F.lit(""))))
    has = lambda names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
    measurement = has(FIELDS["latitude"]) & has(FIELDS["longitude"]) & has(("mcc",)) & has(("mnc",)) & has(FIELDS["rsrp"])
    states = has(("mcc",)) & has(("mnc",)) & has(NR_NAMES) & (has(("utc",)) | (has(("date",)) & has(("time",))))
    return measurement | states


def _clear(rows: DataFrame) -> DataFrame:
    """(path, found) with the first line that names the fields; takes lines with ``utf8``."""
    named = rows.filter(F.col("cells").isNotNull() & _is_header(decoded(F.col("raw"), F.col("utf8"))))
    return named.groupBy("path").agg(F.min(F.struct("line_no", "raw")).alias("found"))


def _followed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of WIDE cells or more with ``wide``, how many of the next LOOK_AHEAD lines are about as wide, and ``seen``, how many there are."""
    ahead = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(1, LOOK_AHEAD)
    near = rows.withColumn("near", F.collect_list("cells").over(ahead)).filter(F.col("cells") >= WIDE)
    return near.select("path", "line_no", "raw", F.size(F.filter("near", lambda w: w >= F.greatest(F.lit(WIDE), F.col("cells") - 1))).alias("wide"), F.size("near").alias("seen"))


def _guess(rows: DataFrame) -> DataFrame:
    """(path, found) of each file from ``_followed``: the first line that wide ones follow, else the first wide one."""
    spot = F.struct("line_no", "raw")
    of = rows.groupBy("path").agg(F.min(F.when(F.col("wide") >= FOLLOWERS, spot)).alias("second"), F.min(spot).alias("third"))
    return of.select("path", F.coalesce("second", "third").alias("found"))


def _in_prefix(head: DataFrame, whole: DataFrame) -> DataFrame:
    """(path, found) of the files whose first lines settle where a wide header is.

    They do if no line that may yet be followed by wide ones stands before the first that
    is, or if they are the whole file.
    """
    near = _followed(head, ["path"]).join(whole, "path")
    sure = F.col("whole") | (F.col("wide") >= FOLLOWERS) | (F.col("seen") == LOOK_AHEAD)
    first_open = F.min(F.when(~sure, F.col("line_no")))
    settled = near.groupBy("path").agg(first_open.alias("open"), F.min(F.when(F.col("wide") >= FOLLOWERS, F.col("line_no"))).alias("second"), F.bool_or("whole").alias("all"))
    settled = settled.filter(F.col("all") | (F.col("second") < F.coalesce("open", F.lit((1 << 63) - 1)))).select("path")
    return _guess(near.join(settled, "path", "left_semi"))


def _in_chunks(rows: DataFrame, blocks: Blocks, chunk: int) -> DataFrame:
    """(path, found) by all lines of some files, ``chunk`` neighbouring ones at a time with those ahead of them.

    Filled lines are numbered by their place in their block and the filled lines of the blocks before it.
    """
    filled = blocks.table.filter(F.col("cells").isNotNull()).join(rows, "path", "left_semi")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = filled.groupBy("path", "start").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("path", "start").orderBy("id"))
    placed = filled.withColumn("inside", inside).join(blocks.held(counts), ["path", "start"]).join(blocks.held(blocks.firsts.select("path", "start", "first")), ["path", "start"])
    placed = placed.select("path", (F.col("start") + F.col("id") - F.col("first")).alias("line_no"), "cells", "raw", (F.col("before") + F.col("inside") - 1).alias("rank"))
    here = F.floor(F.col("rank") / chunk)
    # The first lines of a chunk are ahead of the one before it, too.
    also = F.when((F.col("rank") % chunk < LOOK_AHEAD) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    dealt = placed.withColumn("chunk", F.explode(also))
    return _guess(_followed(dealt, ["path", "chunk"]).groupBy("path", "line_no").agg(F.first("raw").alias("raw"), F.max("wide").alias("wide")))


def file_meta(blocks: Blocks, prefix: int = PREFIX, chunk: int = CHUNK) -> DataFrame:
    """One row for each file: path, utf8, header_line, header, width, technology.

    A header is the first line that names the fields, else the first wide one that wide
    lines follow, else the first wide one, else the first line. It is looked for in the first
    ``prefix`` lines; only files where these don't settle it are searched whole.
    """
    held = blocks.held
    of_file = checkpointed(blocks.firsts.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.max(F.col("start") + F.col("n_lines")).alias("reach")))
    text_of = lambda rows: rows.join(held(of_file.select("path", "utf8")), "path")
    numbered_lines = lines(blocks)
    # Numbers count from 0 by one in the first block, and jump after it.
    head = checkpointed(text_of(numbered_lines.filter((F.col("line_no") < prefix) & F.col("cells").isNotNull())))
    found = checkpointed(_clear(head))
    rest = of_file.join(found, "path", "left_anti")
    if rest.limit(1).count():
        # Files without a clear header in the first lines: one pass over them for one further down, then by width.
        late = _clear(text_of(numbered_lines.join(rest.select("path"), "path", "left_semi").filter(F.col("line_no") >= prefix)))
        late = checkpointed(late)
        rest = rest.join(late, "path", "left_anti")
        whole = rest.select("path", (F.col("reach") <= prefix).alias("whole"))
        early = checkpointed(_in_prefix(head, whole))
        found = found.unionByName(late).unionByName(early)
        left = rest.join(early, "path", "left_anti").select("path")
        if left.limit(1).count():
            found = found.unionByName(_in_chunks(left, blocks, chunk))
        found = checkpointed(found)
    at = checkpointed(of_file.join(found, "path", "left").select("path", "utf8", F.coalesce("found.line_no", F.lit(0).cast("long")).alias("header_line"), F.col("found.raw").alias("raw")))
    body = numbered_lines.join(held(at.select("path", "header_line", F.col("raw").isNull().alias("unnamed"))), "path").filter((F.col("line_no") >= F.col("header_line")) & F.col("cells").isNotNull())
    # Only narrow columns are read again, but for files without any header.
    widest = body.groupBy("path").agg(F.max("cells").alias("width"), F.min(F.when(F.col("unnamed"), F.struct("line_no", "raw"))).alias("top"))
    out = at.join(widest, "path").withColumn("header", decoded(F.coalesce("raw", "top.raw"), F.col("utf8")))
    tokens = F.transform(cells(F.col("header")), lambda c: header_token(c))
    technology = F.when(F.exists(tokens, lambda t: t.contains("nrarfcn")), "5g").when(F.exists(tokens, lambda t: t.contains("earfcn")), "lte").otherwise("unknown")
    return out.select("path", "utf8", "header_line", "header", "width", technology.alias("technology"))


def _place(path: Column, paths: list[str]) -> Column:
    """Which of the given paths, files or folders, a file belongs to."""
    if len(paths) == 1:
        return F.lit(0)
    plain = [re.sub("^file:/+", "/", p).rstrip("/") for p in paths]
    own = F.regexp_replace(path, "^file:/+", "/")
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(plain)]), lambda x: (own == x["p"]) | own.endswith(F.concat(F.lit("/"), F.ltrim(F.lit("/"), x["p"]))) | own.startswith(F.concat(x["p"], F.lit("/"))) | own.contains(F.concat(F.lit("/"), F.btrim(x["p"], F.lit("/")), F.lit("/"))))
    return F.coalesce(F.get(hits, F.lit(0))["i"], F.lit(len(paths)))


def files(spark: SparkSession, paths: list[str], blocks: Blocks | None = None) -> tuple[DataFrame, list[FileMeta]]:
    """The files' table with source_idx and layout, files in the order of their paths as given, and the layouts."""
    rows = file_meta(blocks or blocks_of(spark, paths)).withColumn("place", _place(F.col("path"), paths))
    # Numbered and written once: one small row a file.
    rows = checkpointed(numbered(rows, [F.col("place"), F.col("path")], "source_idx").withColumns({"source_idx": F.col("source_idx").cast("int"), "layout": F.xxhash64("header", "width")}))
    widest = rows.agg(F.max("width")).first()[0] or 1
    first = F.min_by(F.struct("path", "source_idx", "utf8", "header_line", "header", "width", "technology"), "source_idx")
    found = rows.groupBy("layout").agg(first.alias("f")).select("layout", "f.*").withColumn("cut", _cut(F.col("header"), widest)).orderBy("source_idx").collect()
    layouts, numbers = [], []
    for r in found:
        head = list(r.cut)
        while head and not (head[-1] or "").strip():
            head.pop()
        layouts.append(FileMeta(r.path, r.source_idx, r.utf8, r.header_line, column_names(head, r.width), r.technology))
        numbers.append((r.layout, len(numbers)))
    numbers = spark.createDataFrame(numbers, "layout long, layout_no int")
    return rows.join(F.broadcast(numbers), "layout").drop("layout", "place"), layouts


def column_names(header: list[str | None], width: int) -> tuple[str, ...]:
    """Names for all cells: blanks get column_i, repeats a number, cells beyond the header extra_col_k."""
    out: list[str] = []
    for i in range(max(width, len(header))):
        if i < len(header):
            name = (header[i] or "").strip() or f"column_{i + 1}"
        else:
            name = f"extra_col_{i - len(header) + 1}"
        base, k = name, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return tuple(out)


def _cut(text: Column, width: int) -> Column:
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    return F.from_csv(text, F.lit(schema), {"sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, width + 1))})


def inspect(spark: SparkSession, paths: list[str]) -> list[FileMeta]:
    """The layouts of the files, each by the first file that has it, in their order."""
    return files(spark, paths)[1]


def token(name: str) -> str:
    return "".join(ch for ch in name.strip().lower() if ch.isascii() and ch.isalnum())


def canonical(meta: list[FileMeta], mapping: dict[str, str] | None = None, fields: dict[str, tuple[str, ...]] = FIELDS) -> dict[str, dict[str, str]]:
    """For each layout, by its file's path, its columns' names in the union.

    Columns of equal token share the first spelling met. The first column of a file that
    means a logical field takes the field's common name: the mapped column's, else the
    first one met. A column that has that very name goes before other spellings.
    """
    mapping = mapping or {}
    common = dict(mapping)
    spelling: dict[str, str] = {token(v): v for v in mapping.values()}
    out: dict[str, dict[str, str]] = {}
    for m in meta:
        names: dict[str, str] = {}
        for logical, tokens in fields.items():
            exact = [c for c in m.columns if logical in common and token(c) == token(common[logical])]
            found = exact or [c for c in m.columns if token(c) in tokens]
            if found:
                names[found[0]] = common.setdefault(logical, found[0])
                spelling.setdefault(token(found[0]), found[0])
        for c in m.columns:
            if c not in names:
                name = spelling.setdefault(token(c), c)
                names[c] = name if name not in names.values() else c
        out[m.path] = names
    return out


def ambiguous(meta: list[FileMeta]) -> list[tuple[str, str]]:
    """(path, token) where two columns of one file have the same token."""
    out = []
    for m in meta:
        seen = [token(c) for c in m.columns if token(c)]
        out += [(m.path, t) for t in sorted({t for t in seen if seen.count(t) > 1})]
    return out


def missing_fields(meta: list[FileMeta], mapping: dict[str, str] | None = None, states: bool = False) -> list[tuple[str, str]]:
    """(path, field) for required fields that no column of the file stands for; files of states need a time too."""
    mapping = mapping or {}
    fields = STATE_FIELDS if states else FIELDS
    have = lambda m, f: any(token(c) in fields[f] or token(c) == token(mapping.get(f, "\0")) for c in m.columns)
    timed = lambda m: any({*group} <= {token(c) for c in m.columns} for group in TIMES)
    out = [(m.path, f) for m in meta for f in (STATE_FIELDS if states else REQUIRED) if not have(m, f)]
    return out + [(m.path, "time") for m in meta if states and not timed(m)]


def read(spark: SparkSession, paths: list[str], mapping: dict[str, str] | None = None, check: bool = True, states: bool = False) -> DataFrame:
    """``read_named`` without the files' names."""
    return read_named(spark, paths, mapping, check, states)[0]


def read_named(spark: SparkSession, paths: list[str], mapping: dict[str, str] | None = None, check: bool = True, states: bool = False) -> tuple[DataFrame, DataFrame]:
    """All files as one table of text cells, with seq (file order) and source_idx; and (source_idx, path) of the files.

    Missing columns and cells are empty strings. With ``check`` ambiguous headers and
    missing required fields raise an error that names the file. For files of ``states``
    the column of the state, whatever its name in a file, is called NR.
    """
    mapping = (mapping or {}) | ({"nr": NR} if states else {})
    blocks = blocks_of(spark, paths)
    table, meta = files(spark, paths, blocks)
    if check and (bad := ambiguous(meta)):
        raise ValueError("ambiguous columns: " + "; ".join(f"{t} in {p}" for p, t in bad))
    if check and (bad := missing_fields(meta, mapping, states)):
        raise ValueError("missing fields: " + "; ".join(f"{f} in {p}" for p, f in bad))
    names = canonical(meta, mapping, STATE_FIELDS if states else FIELDS)
    union: list[str] = []
    for m in meta:
        union += [n for n in names[m.path].values() if n not in union]
    # For each layout, where each name of the union stands; -1 where it doesn't.
    at = [{names[m.path][c]: i for i, c in enumerate(m.columns)} for m in meta]
    places = spark.createDataFrame([(k, [own.get(n, -1) for n in union]) for k, own in enumerate(at)], "layout_no int, places array<int>")
    table = table.select("path", "source_idx", "utf8", "header_line", "layout_no").join(F.broadcast(places), "layout_no").drop("layout_no")
    body = lines(blocks).join(blocks.held(table), "path").filter("cells is not null and line_no > header_line")
    body = body.select("source_idx", "line_no", "places", decoded(F.col("raw"), F.col("utf8")).alias("text")).filter(F.trim(F.regexp_replace("text", ";", "")) != "")
    width = max((len(m.columns) for m in meta), default=1)
    cut = body.withColumn("cut", _cut(F.col("text"), width)).select("source_idx", "line_no", "places", F.array(*[F.col(f"cut.c{i}") for i in range(width)]).alias("row"))
    seq = (F.col("source_idx").cast("long") * (1 << 40) + F.col("line_no")).alias("seq")
    cell = lambda j: F.coalesce(F.get("row", F.get("places", F.lit(j))), F.lit(""))
    return cut.select("source_idx", *[cell(j).alias(n) for j, n in enumerate(union)], seq), table.select("source_idx", "path")


def suggest(columns: list[str]) -> dict[str, str]:
    """A column for each logical field, by header token."""
    out = {}
    for logical, tokens in FIELDS.items():
        found = [c for t in tokens for c in columns if token(c) == t]
        if found:
            out[logical] = found[0]
    return out


def preview(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each file: encoding, header line, columns, technology, suggested mapping."""
    table, meta = files(spark, paths)
    rows = [(k, list(m.columns), suggest(list(m.columns))) for k, m in enumerate(meta)]
    of_layout = spark.createDataFrame(rows, "layout_no int, columns array<string>, mapping map<string,string>")
    encoding = F.when(F.col("utf8"), "utf-8").otherwise("latin1").alias("encoding")
    return table.join(F.broadcast(of_layout), "layout_no").select("path", encoding, "header_line", "columns", "technology", "mapping")


def _cells(table: DataFrame):
    """A function from header tokens to the first such column, or to an empty text."""
    by_token = {token(c): c for c in reversed(table.columns)}
    return lambda *tokens: next((F.col(f"`{by_token[t]}`") for t in tokens if t in by_token), F.lit(""))


def time_of(table: DataFrame) -> Column:
    """Time of the rows of a table of text cells, in epoch milliseconds."""
    cell = _cells(table)
    return row_time_ms(cell("date"), cell("time"), cell("utc"))


def typed(table: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Typed columns for the operators: signal as text and numbers, time, 5G state.

    The state's column may be chosen as ``nr`` in ``mapping``. Means are taken of rsrp_v and
    sinr_v, the numbers as parsed; rsrp_c and sinr_c are whole hundredths.
    """
    names = suggest([c for c in table.columns if c not in ("seq", SOURCE)]) | (mapping or {})
    cell = _cells(table)
    logical = lambda f: F.col(f"`{names[f]}`") if names.get(f) in table.columns else F.lit("")
    hundredths = lambda f: F.round(parse_number(logical(f)) * 100).cast("bigint")
    state = logical("nr") if names.get("nr") in table.columns else cell(*NR_NAMES)
    return table.select(
        "seq", SOURCE, *[c for c in ("row_id",) if c in table.columns], time_of(table).alias("time_ms"),
        F.trim(logical("mcc")).alias("mcc"), F.trim(logical("mnc")).alias("mnc"), F.trim(logical("pci")).alias("pci"), F.trim(logical("frequency")).alias("frequency"),
        logical("rsrp").alias("rsrp"), parse_number(logical("rsrp")).alias("rsrp_v"), parse_number(logical("sinr")).alias("sinr_v"), hundredths("rsrp").alias("rsrp_c"), hundredths("sinr").alias("sinr_c"),
        logical("latitude").alias("lat"), logical("longitude").alias("lon"), nr_state(state).alias("nr"),
    )


def read_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Second-technology files as one table of text cells; each must have operator, state and a time."""
    return read(spark, paths, states=True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule files as rows (rule, group_id, n_conditions, conditions, assignments).

    The part of <Query> before the first semicolon assigns values; after it, innermost
    parentheses are groups of conditions. Ranges may be given from either end. A file
    without assignments or groups, or with a range in an assignment, has an ``error``.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    # Named by the file, or by the folder that stands for it where Spark has written it.
    file = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    folder = F.regexp_extract("_metadata.file_path", r"/rule=([^/]+)/[^/]+$", 1)
    text = raw.select(F.when(folder != "", F.concat(folder, F.lit(".txt"))).otherwise(F.url_decode(file)).alias("rule"), "value")
    body = F.coalesce(F.nullif(F.regexp_extract("value", r"(?is)<Query>(.*?)</Query>", 1), F.lit("")), F.col("value"))
    item = r'"([^"]+)"\s*=\s*(-?[0-9.,]+(?:\s*-\s*-?[0-9.,]+)?)'
    number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")

    def pairs(part: Column) -> Column:
        ends = lambda v: F.struct(number(F.regexp_extract(v, r"^\s*(-?[0-9.,]+)", 1)).alias("a"), number(F.coalesce(F.nullif(F.regexp_extract(v, r"[0-9.,]\s*-\s*(-?[0-9.,]+)\s*$", 1), F.lit("")), v)).alias("b"))
        return F.transform(
            F.arrays_zip(F.regexp_extract_all(part, F.lit(item), F.lit(1)).alias("f"), F.transform(F.regexp_extract_all(part, F.lit(item), F.lit(2)), ends).alias("e")),
            lambda z: F.struct(z["f"].alias("field"), F.least(z["e"]["a"], z["e"]["b"]).alias("low"), F.greatest(z["e"]["a"], z["e"]["b"]).alias("high")),
        )

    split = text.select("rule", F.regexp_extract(body, r"(?s)^([^;]*);", 1).alias("head"), F.regexp_extract(body, r"(?s)^[^;]*;(.*)$", 1).alias("tail"))
    parsed = split.select("rule", pairs(F.col("head")).alias("assignments"), F.regexp_extract_all("tail", F.lit(r"\(([^()]*)\)"), F.lit(1)).alias("parts"))
    groups = F.filter(F.transform("parts", pairs), lambda g: F.size(g) > 0)
    rows = parsed.select("rule", "assignments", groups.alias("groups"))
    error = F.when(F.size("assignments") == 0, "no assignment").when(F.size("groups") == 0, "no group").when(F.exists("assignments", lambda a: a["low"] != a["high"]), "range in an assignment")
    return rows.select("rule", "assignments", error.alias("error"), F.posexplode_outer("groups").alias("group_id", "conditions")).withColumn("n_conditions", F.size("conditions"))


def rules_of(table: DataFrame) -> list:
    """Rules as the row rewriter takes them; settings, so a short list. Errors are raised."""
    from ..operators.rules import Rule

    found: dict[str, dict] = {}
    for r in sorted(table.collect(), key=lambda r: (r.rule, r.group_id or 0)):
        if r.error:
            raise ValueError(f"{r.rule}: {r.error}")
        own = found.setdefault(r.rule, {"groups": [], "set": {}})
        own["groups"].append(tuple((c.field, c.low, c.high) for c in r.conditions))
        for a in r.assignments:
            values = own["set"].setdefault(a.field, [])
            if a.low not in values:
                values.append(a.low)
    return [Rule(n, tuple(o["groups"]), {k: tuple(v) for k, v in o["set"].items()}) for n, o in found.items()]
