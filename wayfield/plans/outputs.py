"""The zones and operators files of a run, in the input's own columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import int_like, nr_state, number_text, parse_number
from ..functions.shared import checkpointed
from ..operators import densify, zones
from ..sources import sinks, text

#: Notes of generated rows, by zone mode (fixed values of the file format).
EMPTY_NOTES = {False: " # Prázdna zóna - automaticky vygenerovaná", True: " # Prázdny úsek - automaticky vygenerovaný"}
ADDED_NOTES = {False: " # Prázdna zóna - vlastný operátor", True: " # Prázdny úsek - vlastný operátor"}
ROWS, FREQUENCIES = "Riadky_v_zone", "Frekvencie_v_zone"
#: Templates (a row an operator, of some 1 kB) up to which they are sent around.
TEMPLATES = 20_000


@dataclass
class Layout:
    """The input's columns by field; ``columns`` are those of the file, in order."""

    columns: list[str]
    names: dict[str, str]

    def has(self, field: str) -> bool:
        return self.names.get(field) in self.columns

    def place(self) -> tuple[str, str, str]:
        """Names of the columns that order the file's rows: part, line and piece, unless the input has these."""
        taken = {c.lower() for c in self.columns}
        return tuple(next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in ("part", "line", "piece"))


def layout_of(table: DataFrame, fields: dict[str, str], mobile: bool = False) -> Layout:
    """Columns of a table of text cells, without helpers; a run with states adds the state's column."""
    columns = [c for c in table.columns if c not in ("seq", text.SOURCE, "row_id", "time_ms")]
    names = text.suggest(columns) | fields
    chosen = fields.get("nr") or next((c for t in text.NR_NAMES for c in columns if text.token(c) == t), text.NR if mobile else None)
    if chosen:
        names["nr"] = chosen
        columns = columns if chosen in columns else [*columns, chosen]
    return Layout(columns, names)


def plain_coordinate(cell: Column) -> Column:
    """A coordinate as measured, with a point and no needless zeros; other texts stay."""
    return F.coalesce(number_text(parse_number(cell)), cell)


def float_text(cell: Column) -> Column:
    """A number as text with a decimal, 7 as 7.0; other texts stay."""
    return F.coalesce(parse_number(cell).cast("string"), cell)


def _filled(rows: DataFrame, layout: Layout, values: dict[str, Column], part: int, ids: Column, note: Column, line: Column, piece: Column) -> DataFrame:
    """The file's rows: cells of ``rows`` with some fields replaced, then the two columns at the end.

    ``line`` tells measured lines of one order apart, ``piece`` (from 0) the rows of one line.
    """
    by_name = {layout.names[f]: c for f, c in values.items() if layout.has(f)}

    def cell(name: str) -> Column:
        value = F.trim(F.coalesce(by_name.get(name, F.col(f"`{name}`") if name in rows.columns else F.lit("")), F.lit("")))
        if name in (layout.names.get("mcc"), layout.names.get("mnc"), layout.names.get("pci")):
            return int_like(value)
        return F.when(nr_state(value) == "yes", "yes").otherwise("no") if name == layout.names.get("nr") else value

    keys = zones.zone_columns(rows)
    place = [c.alias(n) for c, n in zip((F.lit(part), line.cast("long"), piece.cast("long")), layout.place(), strict=True)]
    return rows.select(*keys, *place, *[cell(c).alias(c) for c in layout.columns], ids.alias(ROWS), note.alias(FREQUENCIES))


def first_rows(own: DataFrame, seqs: DataFrame) -> DataFrame:
    """The rows of ``own`` whose ``seq`` is a ``template_seq`` of ``seqs``, written: one an operator, and sent around if these are few.

    All made rows of an operator have the same template, so they must not meet it by its number.
    """
    seqs = checkpointed(seqs.select(F.col("template_seq").alias("seq")).distinct())
    few = seqs.count() <= TEMPLATES
    found = checkpointed(own.join(F.broadcast(seqs) if few else seqs, "seq", "left_semi"))
    return F.broadcast(found) if few else found


def zones_file(best: DataFrame, empty: DataFrame | None, added: DataFrame | None, cells: DataFrame, lists: DataFrame, layout: Layout, measured_coordinates: bool, templates: DataFrame | None = None) -> DataFrame:
    """Rows of the zones file: measured zones (part 0), empty ones (1) and those of added operators (2).

    ``best``, ``empty`` and ``added`` have lat and lon of their zones as text; ``cells`` are
    the input's cells by ``seq``. A measured row is the first of its group, with the
    group's means; an empty one the first of its operator; an added one the first of
    all. ``templates`` has the ``template_seq`` of each operator; without it they are taken
    from ``empty``, which is then made twice.

    ROWS lists the ids of the rows behind a measured zone, from ``lists`` (of
    ``zones.row_lists``). A group may hold a large part of all rows, so its list comes in
    pieces, each a row with the line's other cells; ``write_zones_file`` joins them.
    Made rows have an empty list.
    """
    segments = "segment_id" in best.columns
    taken = [c for c in layout.columns if c in cells.columns]
    own = cells.select("seq", *[F.col(f"`{c}`").alias(f"cell_{i}") for i, c in enumerate(taken)])

    def met(rows: DataFrame, key: str, firsts: DataFrame = own) -> DataFrame:
        """Zone, values (prefixed) and cells under their own names."""
        joined = rows.join(firsts, F.col(key) == F.col("seq"))
        values = [F.col(c).alias(f"v_{c}") for c in rows.columns if c not in zones.zone_columns(rows)]
        return joined.select(*zones.zone_columns(rows), *values, *[F.col(f"cell_{i}").alias(c) for i, c in enumerate(taken)])

    v = lambda c: F.col(f"v_{c}")
    cell = lambda f: F.col(f"`{layout.names[f]}`")
    measured = met(best, "first_seq")
    values = {"rsrp": sinks.fixed(v("rsrp"), 2), "frequency": v("frequency"), "pci": v("pci"), "nr": v("nr")}
    if layout.has("sinr"):
        values["sinr"] = F.when(v("sinr").isNotNull(), sinks.fixed(v("sinr"), 2)).otherwise(cell("sinr"))
    for f in ("latitude", "longitude"):
        values[f] = plain_coordinate(cell(f)) if measured_coordinates else v(f[:3])
    # Pieces of a group with most rows share one key: the join splits them by size, as no step after it needs a group together.
    group = [*zones.OPERATOR, "frequency", "pci"]
    pieces = lists.select(*zones.zone_columns(best), *[F.col(c).alias(f"v_{c}") for c in group], F.col("piece").alias("v_piece"), F.col("ids").alias("v_ids"))
    measured = measured.join(pieces, [*zones.zone_columns(best), *[f"v_{c}" for c in group]])
    nth = v("piece") - F.floor(v("first_seq") / zones.PIECE)
    out = _filled(measured, layout, values, 0, v("ids"), F.concat(v("frequency"), F.lit(" # Meraní: "), v("n").cast("string")), v("first_seq"), nth)
    for part, rows, notes, seqs in ((1, empty, EMPTY_NOTES, templates), (2, added, ADDED_NOTES, None)):
        if rows is not None:
            # Added operators have the first row of all.
            seqs = first_seq(cells) if part == 2 else rows if seqs is None else seqs
            made = met(rows, "template_seq", first_rows(own, seqs))
            values = {"rsrp": F.lit("-174"), "mcc": v("mcc"), "mnc": v("mnc"), "nr": F.lit("no"), "latitude": v("lat"), "longitude": v("lon")}
            if layout.has("sinr"):
                values["sinr"] = float_text(cell("sinr"))
            if part == 2:
                values["pci"] = v("pci")
            out = out.unionByName(_filled(made, layout, values, part, F.lit(""), F.lit(notes[segments]), F.lit(None), F.lit(0)))
    return out


def file_keys(rows: DataFrame, layout: Layout) -> list[Column]:
    """Keys of the file's order, nulls last: measured rows by operator and PCI, then empty and added ones by zone; pieces in a row."""
    part, line, piece = map(F.col, layout.place())
    by_value = [k for f in ("mcc", "mnc", "pci") for c in [F.col(f"`{layout.names[f]}`")] for k in (parse_number(c), c)]
    zone = [F.col(k) for k in zones.zone_columns(rows)]
    return [part, *[F.when(part > 0, k) for k in zone], *by_value, *zone, line, piece]


def write_zones_file(rows: DataFrame, layout: Layout, path: str, single: bool = False) -> None:
    """The zones file as text parts in order: an empty line, the header, the rows.

    Each piece of a list is written as it comes, between the head and the tail of its
    line, so no task holds a whole list. A long line may go on in the next part.
    """
    part, _, piece = map(F.col, layout.place())
    header = "\n" + ";".join([*layout.columns, ROWS, FREQUENCIES]) + "\n"
    head = F.concat(sinks.line_of(layout.columns), F.lit(";"), F.col(ROWS))
    tail = F.concat(F.lit(";"), F.coalesce(F.col(FREQUENCIES), F.lit("")), F.lit("\n"))
    last = F.lit((1 << 63) - 1)
    at = lambda place, text: F.struct(place.alias("place"), text.alias("text"))
    begun, more = F.array(at(piece, head), at(last, tail)), F.array(at(piece, F.concat(F.lit(","), F.col(ROWS))))
    texts = F.when(part > 0, F.array(at(piece, F.concat(head, tail)))).when(piece == 0, begun).otherwise(more)
    keys = [k.alias(f"k{i}") for i, k in enumerate(file_keys(rows, layout)[:-1])]
    placed = rows.select(*keys, F.explode(texts).alias("t")).select(*[f"k{i}" for i in range(len(keys))], "t.place", "t.text")
    body = placed.orderBy(*[F.col(c).asc_nulls_last() for c in placed.columns[:-1]]).select("text")
    sinks.write_pieces(body, header, path, single)


def positions(rows: DataFrame, size: float, starts: DataFrame | None = None) -> DataFrame:
    """``rows`` with lat and lon of their zone as text of six decimals."""
    placed = zones.with_positions(rows, size, starts)
    return placed.withColumns({c: sinks.fixed(F.col(c), 6) for c in ("lat", "lon")})


def added_operators(spark: SparkSession, custom: tuple[tuple[str, str, str], ...]) -> DataFrame:
    return spark.createDataFrame([tuple(map(str, c)) for c in custom], "mcc string, mnc string, pci string")


def first_seq(cells: DataFrame) -> DataFrame:
    """One row: the first row's number."""
    return cells.agg(F.min("seq").alias("template_seq"))


def added_rows(best: DataFrame, every: DataFrame, custom: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of added operators in all zones, with the first row of all as their template."""
    return densify.custom_zones(custom, best, every).crossJoin(F.broadcast(first_seq(cells)))  # one row


