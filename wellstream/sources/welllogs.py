"""XML well logs as splittable records.

A file is read in pieces that end where the next tag begins, so a file of many gigabytes becomes many tasks. Data lines
never meet in one row: runs of plain ``<data>`` elements leave the text, and an empty element that names the run stays in
their place. What remains of a document, its header, is small; a real XML parser judges it and resolves namespaces, and
the order of the runs it finds numbers the lines.

A data element is plain if it has no attributes, no children, no entities but the predefined ones, and no characters that
XML forbids. Any other one stays in the header text, where the parser reads it. Comments are left out wherever they begin
and end; a CDATA section that holds the text ``<!--`` or a whole data element is not told apart from the real thing.
"""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wellstream.schemas import LOG_HEADER_SCHEMA, LOG_NAMESPACE
from wellstream.session import written

RUN_ATTRIBUTE = "wellstream-run"
DATA_OPEN = r"^((?:[A-Za-z_][\w.\-]*:)?data)>"
#: What the text of a plain element doesn't have once its entities are gone.
#: Most texts are of USUAL characters only, which takes one quick pass to tell.
USUAL = r"\A[\t\n\r -%'-\\^-~]*+\z"
PREDEFINED, FORBIDDEN = r"&(?:lt|gt|amp|quot|apos);", r"[&\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]|\]\]>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
IN_COMMENT, OUTSIDE = 1, 0
WHITE_SPACE = " \t\n\x0b\f\r"


def read_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """(path, block, at, opens, piece): the text of all files, cut before each tag; ``opens`` where a ``<`` stood.

    (block, at) orders the pieces of a file; a block is what one task reads of it.
    """
    read = spark.read.option("lineSep", "<").text(directory)
    rows = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    place = Window.partitionBy("path", "block").orderBy("at")
    return rows.withColumn("opens", (F.col("block") > 0) | (F.row_number().over(place) > 1))


def split_pieces(fragments: DataFrame) -> DataFrame:
    """The same from rows (path, block, at, text) that each begin with a tag; ``at`` may have 2^31 values.

    Whatever reads the pieces wants them by block, so the texts are shuffled once, before they are split, and derived once.
    """
    placed = fragments.select("path", "block", "at", "text").where("path is not null and block is not null").repartition("path", "block")
    found = placed.select("path", "block", "at", F.posexplode(F.split("text", "<")).alias("_i", "piece")).where("_i > 0")
    return found.select("path", "block", (F.col("at") * (1 << 20) + F.col("_i")).alias("at"), "piece", F.lit(True).alias("opens"))


def _without_comments(pieces: DataFrame) -> DataFrame:
    """Adds ``text``: the piece with its ``<``, or what follows a comment that ends in it."""
    starts = F.col("opens") & F.startswith("piece", F.lit("!--"))
    rest = F.when(starts, F.substr("piece", F.lit(4))).otherwise(F.col("piece"))
    end = F.instr(rest, F.lit("-->"))
    event = F.when(end > 0, OUTSIDE).when(starts, IN_COMMENT)
    marked = pieces.select("*", event.alias("_event"), starts.alias("_starts"), F.when(end > 0, F.substr(rest, end + 3)).alias("_rest"))
    # numbers, so that this is a hash aggregate; only blocks that begin within a comment are joined to their pieces
    blocks = marked.groupBy("path", "block").agg(F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("at"))).alias("_last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("path", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where(F.col("_carried") == IN_COMMENT)
    before = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("_event", ignorenulls=True).over(before), F.col("_carried"), F.lit(OUTSIDE))
    placed = marked.where("path is not null and block is not null").join(carried, ["path", "block"], "left").withColumn("_state", state)
    inside = F.col("_starts") | (F.col("_state") == IN_COMMENT)
    text = F.when(inside, F.col("_rest")).otherwise(F.concat(F.when(F.col("opens"), "<").otherwise(""), F.col("piece")))
    # a blank between a comment and the next tag would part lines that belong to one run
    return placed.select("path", "block", "at", inside.alias("_inside"), text.alias("text")).where("text is not null and not (_inside and trim(text) = '')")


def tokens(pieces: DataFrame) -> DataFrame:
    """(path, block, at, text, run, nth, name, line): ``line`` is the value of a plain data element, ``text`` that of any other token.

    ``run`` grows with every token that is no plain data element, and where the name of these changes; ``nth`` counts the plain ones of the block.
    """
    order = Window.partitionBy("path", "block").orderBy("at")
    tag = F.expr("substring(text, 2)")
    is_end = F.startswith("text", F.lit("</"))
    found = _without_comments(pieces).select(
        "*", F.when(F.startswith("text", F.lit("<data>")), "data")
        .when(F.startswith("text", F.lit("<")) & ~is_end, F.regexp_extract(tag, DATA_OPEN, 1)).alias("_name"),
        F.when(is_end, F.rtrim("text", F.lit(WHITE_SPACE))).alias("_end"))
    value = F.substr("text", F.length("_name") + 3)
    entities = F.contains(value, F.lit("&"))
    may_be_plain = F.is_valid_utf8(value) & (value.rlike(USUAL) | ~F.when(entities, F.regexp_replace(value, PREDEFINED, "")).otherwise(value).rlike(FORBIDDEN))
    line = value
    for entity, character in ENTITIES:
        line = F.when(entities, F.replace(line, F.lit(entity), F.lit(character))).otherwise(value)
    # names of elements that are plain if the next token ends them; one window looks at both neighbours
    marked = found.select("path", "block", "at", "text", "_end", F.when((F.col("_name") != "") & may_be_plain, F.col("_name")).alias("_name"))

    def ends(end: Column, name: Column) -> Column:
        return F.coalesce(end == F.concat(F.lit("</"), name, F.lit(">")), F.lit(False))

    one, two = F.lag("_name").over(order), F.lag("_name", 2).over(order)
    seen = marked.select("*", one.alias("_one"), two.alias("_two"), F.lag("_end").over(order).alias("_end_before"), F.lead("_end").over(order).alias("_next_end"))
    told = seen.where(~ends(F.col("_end"), F.col("_one"))).select(
        "path", "block", "at", "text", "_name", ends(F.col("_next_end"), F.col("_name")).alias("_plain"),
        # the token before is the end of a plain element of another name
        (ends(F.col("_end_before"), F.col("_two")) & F.coalesce(F.col("_two") != F.col("_name"), F.lit(False))).alias("_other_name"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    breaks = ~F.col("_plain") | F.col("_other_name")
    return told.select(
        "path", "block", "at", F.when(~F.col("_plain"), F.col("text")).alias("text"),
        F.count_if(breaks).over(so_far).alias("run"), F.count_if("_plain").over(so_far).alias("nth"),
        F.when(F.col("_plain"), F.col("_name")).alias("name"), F.when(F.col("_plain"), line).alias("line"))


def header_texts(found: DataFrame) -> DataFrame:
    """(path, header): each document without its plain data lines; runs of them are named."""
    # a run is the token that opens it and the plain lines after that, of which numbers are enough
    plain = found.where("name is not null").groupBy("path", "block", "run", "name").agg(
        F.min("at").alias("at"), F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    marker = F.concat(F.lit("<"), F.col("name"), F.lit(f' {RUN_ATTRIBUTE}="'), F.concat_ws(":", "block", "run", "first", "n"), F.lit('"/>'))
    others = found.where("name is null").select("path", "block", "at", "text")
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "text")))
    return others.unionByName(plain.select("path", "block", "at", marker.alias("text"))).groupBy("path").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("header"))


def _tag(name: str) -> str:
    return f"{{{LOG_NAMESPACE}}}{name}"


def _value(parent: ElementTree.Element, name: str) -> str | None:
    found = parent.find(_tag(name))
    return None if found is None else "".join(found.itertext()).strip()


def parse_header(text: bytes | None) -> dict:
    """The header of one document, and what its first data block holds: runs of plain lines, or single lines, in order."""
    try:
        root = ElementTree.fromstring(text or b"")
    except (ElementTree.ParseError, ValueError, LookupError):
        return {"malformed": True}
    logs = [e for e in root.iter(_tag("log")) if e is not root]
    head = {"malformed": False, "xmlns": root.tag[1:].partition("}")[0] if root.tag.startswith("{") else None, "version": root.get("version"), "log_count": len(logs)}
    if not logs:
        return head
    log = logs[0]
    for column, name in (("uid_well", "uidWell"), ("uid_wellbore", "uidWellbore"), ("uid", "uid")):
        head[column] = None if log.get(name) is None else log.get(name).strip()
    for column, name in (("name_well", "nameWell"), ("name_wellbore", "nameWellbore"), ("index_type", "indexType"), ("index_curve", "indexCurve")):
        head[column] = _value(log, name)
    head["name"] = _value(log, "name") or ""
    head["curves"] = [
        {"mnemonic": _value(c, "mnemonic"), "unit": _value(c, "unit") or "", "null_value": _value(c, "nullValue") or ""}
        for c in log.findall(_tag("logCurveInfo"))
    ]
    data = log.find(_tag("logData"))
    head["has_log_data"] = data is not None
    if data is not None:
        head["mnemonic_list"], head["unit_list"] = _value(data, "mnemonicList"), _value(data, "unitList")
        head["parts"], before = [], 0
        for e in data.findall(_tag("data")):
            named = e.get(RUN_ATTRIBUTE)
            block, run, first, n = map(int, named.split(":")) if named else (None, None, None, 1)
            head["parts"].append({"block": block, "run": run, "first": first, "before": before, "line": None if named else "".join(e.itertext())})
            before += n
    return head


def documents(headers: DataFrame, device_id: Column | str) -> DataFrame:
    """L2, L3: header columns of each document and ``parts``, where its lines are.

    headers: (path, header); device_id: a name, or an expression over path. A null header is malformed.
    """

    arrow = to_arrow_schema(LOG_HEADER_SCHEMA)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [{"path": p, **parse_header(h)} for p, h in zip(batch.column("path").to_pylist(), batch.column("header").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    parsed = headers.select("path", F.col("header").cast("binary").alias("header")).mapInArrow(run, LOG_HEADER_SCHEMA)
    device = F.lit(device_id) if isinstance(device_id, str) else device_id
    return parsed.withColumn("device_id", device).withColumn("log_count", F.coalesce("log_count", F.lit(0)))


def lines(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, line_no, line) of the first data block of each document, numbered from 1."""
    parts = docs.select("path", F.inline("parts"))
    runs = parts.where("line is null").select("path", "block", "run", "first", "before")
    plain = found.where("line is not null").select("path", "block", "run", "nth", "line").join(runs, ["path", "block", "run"])
    numbered = plain.select("path", (F.col("before") + F.col("nth") - F.col("first") + 1).alias("line_no"), "line")
    single = parts.where("line is not null").select("path", (F.col("before") + 1).alias("line_no"), "line")
    return numbered.unionByName(single)


def read_well_logs(spark: SparkSession, directory: str, device_id: Column | str) -> tuple[DataFrame, DataFrame]:
    """Documents and lines of all files of a directory; an empty file is a malformed document."""
    found = written(tokens(read_pieces(spark, directory)))  # else each use would read and part all texts again
    known = header_texts(found)
    # scans pass over empty files, the listing has them
    paths = spark.createDataFrame([(path,) for path in spark.read.text(directory).inputFiles()], "path string")
    key = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    empty = paths.withColumn("path", key).join(known.select(key.alias("path")), "path", "left_anti")
    headers = known.unionByName(empty.select("path", F.lit("").alias("header")))
    docs = written(documents(headers, device_id))
    return docs, lines(found, docs)


__all__ = ["documents", "header_texts", "lines", "parse_header", "read_pieces", "read_well_logs", "split_pieces", "tokens"]
