"""Line dedup by content-defined chunks, in DataFrame expressions only.

A text is cut into units, its lines and the sentences of longer ones. A rolling hash over the hashes of the last units ends a chunk
wherever it falls into the lower part of its range, so boundaries follow the words and not their numbers, and a passage is
cut alike wherever it stands. Chunks that are found again anywhere are compared by their bytes. A passage seldom begins and ends
at a boundary, so a found chunk is extended over the units beside it as far as they equal those beside the first one. Stretches of
found units with enough words are removed, all but the first.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailquill.llm.common import fresh, row_place
from mailquill.session import materialize

#: Units of the rolling hash, its base and modulus (which does not divide base - 1), and the part of its range that ends a chunk.
#: A boundary depends on WINDOW units, so a passage of few units has the more chunks of its own the smaller that is.
WINDOW, BASE, MODULUS, PART = 1, 31, 1_000_003, (2, 3)
LEAST_WORDS = 40
#: A stretch is looked at from a fourth of the least words on.
LEAST_PART = 4
SPACE = " \t\n\x0b\f\r"
MARKS = ".!?…"
ENDS = ("\n", *(f"{mark} " for mark in MARKS))
#: Up to a line's end, or a mark and a space, and all white space behind it. Blank texts have no unit.
UNIT = rf"(?s)[ \t\n\x0B\f\r]*(?:[{MARKS}] |[^ \t\n\x0B\f\r].*?(?:\n|[{MARKS}] |\z))[ \t\n\x0B\f\r]*"
#: Cuts a text in which it does not occur.
CUT = "\x01"


def line_units(text: Column) -> Column:
    """Array of strings that joined give the text again, unless it is blank."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``; a one-element array binds an expression to a name, so that it is worked out once."""
    return F.transform(F.array(value), body)[0]


def _cut(text: Column, ends: dict[str, str]) -> Column:
    """``text`` with each end in its new form. To look for an end takes a small part of the time of replacing it; nothing replaces ""."""
    cut = text
    for end, new in ends.items():
        cut = F.replace(cut, F.when(F.contains(text, F.lit(end)), F.lit(end)).otherwise(F.lit("")), F.lit(new))
    return cut


def _any_in(text: Column, parts: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(part)) for part in parts))


UNIT_ENDS = {end: end + CUT for end in ENDS}
KEY_ENDS = {end: end.strip(SPACE) + CUT for end in ENDS}


def _units_of_parts(text: Column, parts: Column) -> Column:
    """``_units`` of a text and what ``_cut`` by ``UNIT_ENDS`` and a split made of it."""
    odd = F.contains(text, F.lit(CUT)) | F.exists(parts, lambda part: F.substring(part, 1, 1).isin(*SPACE))
    return F.when(odd, line_units(text)).otherwise(F.array_remove(parts, ""))


def _units(text: Column) -> Column:
    """``line_units``, cut without a regular expression where no white space begins the text or follows an end."""
    return _bound(F.split(_cut(text, UNIT_ENDS), CUT, -1), lambda parts: _units_of_parts(text, parts))


def _odd(text: Column) -> Column:
    """Whether there is other white space than spaces and line's ends, or a CUT. To look for the one or other is to go over the text."""
    return _any_in(text, [*SPACE.replace(" ", "").replace("\n", ""), CUT])


def _keys_of_parts(text: Column, odd: Column, parts: Column) -> Column:
    """``_keys`` of a text, its ``_odd``, and what ``_cut`` by ``KEY_ENDS`` and a split made of it."""
    trimmed = lambda parts: F.filter(F.transform(parts, lambda part: F.btrim(part, F.lit(SPACE))), lambda key: key != "")
    spaced = F.exists(parts, lambda part: F.startswith(part, F.lit(" ")) | F.endswith(part, F.lit(" ")))
    plain = F.when(odd | spaced, trimmed(parts)).otherwise(F.array_remove(parts, ""))
    return F.when(odd & F.contains(text, F.lit(CUT)), trimmed(line_units(text))).otherwise(plain)


def _keys(text: Column) -> Column:
    """The units of ``line_units`` without the white space around them, cut without a regular expression where that can be.

    Only where there is other white space than single spaces and ends are the parts trimmed.
    """
    return _bound(F.split(_cut(text, KEY_ENDS), CUT, -1), lambda parts: _keys_of_parts(text, _odd(text), parts))


def _n_words(unit: Column) -> Column:
    """Words of a trimmed unit: its spaces and one."""
    return F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "), F.lit(""))) + 1


def _hash(text: Column) -> Column:
    """Tells most chunks apart; those that it does not are told apart by their bytes."""
    return F.xxhash64(text)


def _part(of: Column, after: Column, n: Column) -> Column:
    """``n`` elements behind the first ``after``. Most chunks have one unit, for which no slice is made."""
    return F.when(n == 1, F.array(F.get(of, after))).otherwise(F.slice(of, after + 1, n))


def _joined_units(units: Column, after: Column, n: Column, between: str = "\n") -> Column:
    return F.when(n == 1, F.get(units, after)).otherwise(F.array_join(F.slice(units, after + 1, n), between))


def _ends(keys: Column) -> Column:
    """Numbers, from 1, of the units that end a chunk."""
    code = lambda i: F.conv(F.substring(F.md5(F.get(keys, i).cast("binary")), 1, 8), 16, 10).cast("bigint")

    def of(code, n: Column) -> Column:
        def ends_chunk(i: Column) -> Column:
            rolling = sum((code(i - 1 - back) * F.lit(BASE**back) for back in range(1, WINDOW)), code(i - 1))
            low = rolling % MODULUS < -(-MODULUS * PART[0] // PART[1])
            return (i == n) | (low if WINDOW == 1 else (i >= WINDOW) & low)

        numbers = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), ends_chunk)
        return F.when(n > 0, numbers).otherwise(F.array().cast("array<int>"))

    if WINDOW == 1:  # each code is asked for once
        return of(code, F.size(keys))
    codes = F.transform(keys, lambda key, i: code(i))
    return _bound(codes, lambda codes: of(lambda i: F.get(codes, i), F.size(codes)))


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``keys`` of rows with a ``text`` and its ``odd``.

    Here and below, columns of one step after the other and not names bound in one expression, since what those hold is
    copied wherever one ends.
    """
    parts = rows.select(*columns, "text", "odd", F.split(_cut(F.col("text"), KEY_ENDS), CUT, -1).alias("parts"))
    return parts.select(*columns, _keys_of_parts(F.col("text"), F.col("odd"), F.col("parts")).alias("keys"))


#: Stands between the units of a chunk whose words are counted: no unit has a line's end, and it is one space.
BETWEEN = "\n "


def _marks(rows: DataFrame) -> DataFrame:
    """``place``, ``odd`` of the text, ``edges``, which are 0 and the numbers of the units that end a chunk, and of the chunks ``hashes`` and ``words``."""
    edges = F.col("edges")
    keyed = _keyed(rows.withColumn("odd", _odd(F.col("text"))), "place", "odd")
    edged = keyed.select("place", "odd", "keys", F.concat(F.array(F.lit(0)), _ends(F.col("keys"))).alias("edges"))
    whole = F.transform(F.slice(edges, 2, F.size(edges) - 1), lambda end, at: _joined_units(F.col("keys"), F.get(edges, at), end - F.get(edges, at), BETWEEN))
    cut = edged.select("place", "odd", "edges", whole.alias("whole"))
    return cut.select("place", "odd", "edges", F.transform("whole", lambda own: _hash(own)).alias("hashes"), F.transform("whole", _n_words).alias("words"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Of the chunks in ``runs``: ``no``, ``first`` and ``last`` unit, ``own`` text, and hashes of the units ``back`` and ``ahead``.

    Of the chunk before and after it, that is. Only units in the same places beside equal chunks are ever compared by them.
    """
    edge = lambda no: F.get("edges", no)
    columns = ["id", "place", "runs", "edges"]
    hashed = _keyed(rows, *columns).select(*columns, "keys", F.transform("keys", lambda key: F.xxhash64(key)).alias("hashes"))
    beside = lambda no: F.coalesce(_part(F.col("hashes"), edge(no - 1), edge(no) - edge(no - 1)), F.array().cast("array<bigint>"))

    def chunk(no: Column) -> Column:
        own = _joined_units(F.col("keys"), edge(no - 1), edge(no) - edge(no - 1))
        first, last = (edge(no - 1) + 1).alias("first"), edge(no).alias("last")
        return F.struct(no.alias("no"), first, last, own.alias("own"), beside(no - 1).alias("back"), beside(no + 1).alias("ahead"))

    numbers = F.flatten(F.transform("runs", lambda run: F.sequence(run["from"], run["to"])))
    # No text without runs is here. To leave out those without would work the chunks out twice.
    found = hashed.select("id", "place", F.transform(numbers, chunk).alias("c"))
    return found.select("id", "place", F.explode_outer("c").alias("c")).select("id", "place", "c.*")


def _alike(a: Column, b: Column, turned: bool = False) -> Column:
    """How many first elements are the same, or last ones; element by element only where that is neither all nor none."""
    one = lambda of: F.get(of, F.size(of) - 1 if turned else F.lit(0))
    way = F.reverse if turned else lambda of: of
    differ = F.array_position(F.zip_with(way(a), way(b), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    some = F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")
    return F.when(a == b, F.size(a)).when(~one(a).eqNullSafe(one(b)), F.lit(0)).otherwise(some)


def _found(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``place`` of a row and ``ranges``, struct(``first``, ``last``) of units that are found before, apart from each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), row_place(F.col(id_col), text).alias("place"), text.alias("text"))
    marks = materialize(_marks(rows), "chunk-marks")
    repeated = materialize(marks.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    # The joins' smaller sides grow with the corpus and are never broadcast. Where they are narrow and have each key once, a
    # partition of them is a small part of the other side's and is hashed, so that neither side is sorted.
    chunks = marks.select("place", F.posexplode(F.arrays_zip("hashes", "words")).alias("at", "c"))
    chunks = chunks.select("place", (F.col("at") + 1).alias("no"), F.col("c.hashes").alias("hash"), F.col("c.words").alias("words"))
    again = chunks.join(repeated.hint("shuffle_hash"), "hash").select("place", "no", "words")
    # Rows that repeat id and text are one; everything down to the wanted numbers keeps to this partitioning.
    again = again.repartition("place").dropDuplicates(["place", "no"])
    # Only stretches of repeated chunks that hold some part of the words needed are looked at; their ends may bring the rest.
    row = Window.partitionBy("place").orderBy("no")
    stretch = again.withColumn("stretch", F.col("no") - F.row_number().over(row))
    long_enough = F.sum("words") * LEAST_PART >= least
    wanted = stretch.groupBy("place", "stretch").agg(F.min("no").alias("from"), F.max("no").alias("to"), long_enough.alias("enough"))
    wanted = wanted.where("enough").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    wanted = materialize(wanted, "wanted-chunks")

    # Edges are carried here, since to work them out again takes longer. Their rows repeat where rows repeat id and text.
    edged = marks.select("place", "odd", "edges").join(wanted.hint("shuffle_hash"), "place").dropDuplicates(["place", "odd", "runs", "edges"])
    cut = _chunks(rows.join(edged.hint("shuffle_hash"), "place"))
    cut = materialize(cut.withColumn("hash", _hash(F.col("own"))), "chunks")
    # Copies are combined before the shuffle. A hash whose least and greatest bytes are the same has one text, and its chunks meet
    # their first one without their texts.
    first = F.min(F.struct("id", "place", "no", "back", "ahead")).alias("f")
    firsts = cut.groupBy("hash").agg(first, (F.min("own") == F.max("own")).alias("one_text"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.where("n > 1").drop("n"), "first-chunks")
    beside = ["place", "no", "first", "last", "back", "ahead", "f"]
    both = cut.drop("own").join(firsts.where("one_text").hint("shuffle_hash"), "hash").select(beside)
    shared = materialize(firsts.where("NOT one_text").select("hash"), "shared-hashes")
    if not shared.isEmpty():
        told = materialize(cut.join(shared, "hash"), "chunks-of-shared-hashes")
        both = both.unionAll(told.join(told.groupBy("hash", "own").agg(first), ["hash", "own"]).select(beside))
    later = both.where((F.col("place") != F.col("f.place")) | (F.col("no") != F.col("f.no")))
    back = _alike(F.col("back"), F.col("f.back"), turned=True)
    spans = later.select("place", (F.col("first") - back).alias("first"), (F.col("last") + _alike(F.col("ahead"), F.col("f.ahead"))).alias("last"))
    spans = spans.distinct()

    order = Window.partitionBy("place").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("first") > reached + 1)).cast("int")
    numbered = spans.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(order))
    stretches = numbered.groupBy("place", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ranges = F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges")
    return materialize(stretches.groupBy("place").agg(ranges), "found-ranges")


def _without(units: Column, ranges: Column) -> Column:
    """The text without the ranges; where a removed one ended a line in which others stay, the unit before it ends it."""
    ends_line = lambda no: F.contains(F.get(units, no - 1), F.lit("\n"))
    n = F.size(units)
    end = F.struct((n + 1).alias("first"), (n + 1).alias("last"), F.lit(0).alias("words"))

    def joined(all_ranges: Column) -> Column:
        def piece(own: Column, at: Column) -> Column:
            begin = F.when(at == 0, F.lit(1)).otherwise(F.get(all_ranges, at - 1)["last"] + 1)
            kept = F.array_join(F.slice(units, begin, own["first"] - begin), "")
            broken = (own["first"] > begin) & (own["last"] < n) & ends_line(own["last"]) & ~ends_line(own["first"] - 1)
            return F.concat(kept, F.when(broken, F.lit("\n")).otherwise(""))

        return F.array_join(F.transform(all_ranges, piece), "")

    return _bound(F.concat(ranges, F.array(end)), joined)


def _joined(docs: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, str]:
    """``docs`` with struct(``ranges``, ``units``, ``words``, ``text``) of what is removed and what is left; NULL if nothing is."""
    place, name = fresh(docs, "row_place"), fresh(docs, "removed")
    found = _found(docs, id_col, text_col, least).withColumnsRenamed({"place": place, "ranges": name})
    marked = docs.withColumn(place, row_place(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    joined = marked.join(found.hint("shuffle_hash"), place, "left").drop(place)
    # Columns, as in _keyed. Only texts of which something is found are cut.
    parts, units, text, found_any = fresh(docs, "text_parts"), fresh(docs, "text_units"), F.col(text_col), F.col(name).isNotNull()
    joined = joined.withColumn(parts, F.when(found_any, F.split(_cut(text, UNIT_ENDS), CUT, -1)))
    joined = joined.withColumn(units, F.when(found_any, _units_of_parts(text, F.col(parts)))).drop(parts)

    def with_words(own: Column) -> Column:
        keys = F.transform(F.slice(units, own["first"], own["last"] - own["first"] + 1), lambda unit: F.btrim(unit, F.lit(SPACE)))
        return F.struct(own["first"].alias("first"), own["last"].alias("last"), _n_words(F.array_join(keys, BETWEEN)).alias("words"))

    joined = joined.withColumn(name, F.filter(F.transform(name, with_words), lambda own: own["words"] >= least))
    total = lambda size: F.aggregate(name, F.lit(0).cast("bigint"), lambda n, own: n + size(own))
    removed = F.struct(
        F.col(name).alias("ranges"), total(lambda own: own["last"] - own["first"] + 1).alias("units"),
        total(lambda own: own["words"]).alias("words"), _without(F.col(units), F.col(name)).alias("text"))
    return joined.withColumn(name, F.when(F.size(name) > 0, removed)).drop(units), name


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the stretches of ``least`` words or more that are found before; rows and other columns as before.

    Of equal chunks the first stays: the one with the smallest id (NULL first), hash of id and text, and place in the text. Rows
    that repeat both id and text are one document, whose units stay or go in all of them alike. Units are compared without the white
    space around them, words are told apart by spaces. Repeated chunks that stand together count from a fourth of ``least`` words on.
    A text that loses all its units becomes empty; NULL and blank texts stay as they are.
    """
    joined, removed = _joined(docs, id_col, text_col, least)
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.col(f"{removed}.text"))
    return joined.withColumn(text_col, text).select(docs.columns)


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per row: id, removed units (``first-last`` of each stretch, numbered from 1), their number and words, the kept text's SHA-256.

    NULL counts as an empty text.
    """
    joined, removed = _joined(docs, id_col, text_col, least)
    name = lambda own: F.concat_ws("-", own["first"], own["last"])
    text = F.coalesce(f"{removed}.text", text_col, F.lit(""))
    return joined.select(
        F.col(id_col),
        F.coalesce(F.array_join(F.transform(f"{removed}.ranges", name), ","), F.lit("")).alias("removed_units"),
        F.coalesce(f"{removed}.units", F.lit(0).cast("bigint")).alias("n_removed_units"),
        F.coalesce(f"{removed}.words", F.lit(0).cast("bigint")).alias("n_removed_words"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )
