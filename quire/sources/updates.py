"""Incremental updates: text on the pages of files whose own bytes stay as they are.

Everything behind the old bytes is made as rows: new objects take numbers above all that a file uses, pages get the
text as one more stream, the font goes to where a page's resources are (its own, an ancestor's, or an object that pages
share), and offsets and the new table of references are sums and runs over a file's new objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from quire.functions.geometry import placement
from quire.functions.numbers import number_text
from quire.functions.text import escaped
from quire.plans.staging import stage_rows
from quire.sources.content import dictionary, numbers, positioned_runs, reference, references
from quire.sources.documents import page_leaves
from quire.sources.structure import parsed, ref_of, spans, values

#: The font that the text is shown in, and the name that pages know it by.
FONT_BODY = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
FONT = "QuireText"
INHERITED = ["Resources", "MediaBox", "Rotate"]
TURNS = {0: "1 0 0 1", 90: "0 1 -1 0", 180: "-1 0 0 -1", 270: "0 -1 1 0"}


def page_rows(told: DataFrame, key: str) -> DataFrame:
    """(key, page, obj, gen, head, Contents, Resources, MediaBox, Rotate) of all pages of parsed() files, in order.

    The last three are inherited from the nearest ancestor that has them; raw values.
    """
    objects = told.where("obj IS NOT NULL")
    nodes = objects.where("node IS NOT NULL AND kind <> '/Catalog'").select(
        key, "obj", F.when(F.col("kind") != "/Page", F.col("kids")).alias("kids"), *[F.col("node")[c].alias(c) for c in INHERITED])
    ends = told.where("obj IS NULL AND ending.state = 'open'").select(key, F.col("ending.root").alias("obj"))
    roots = objects.select(key, "obj", F.col("node")["Pages"].alias("tree")).join(ends, [key, "obj"]).select(key, reference(F.col("tree")).alias("obj")).where("obj IS NOT NULL")
    leaves = page_leaves(nodes, roots, key, carry=INHERITED)
    return leaves.join(objects.select(key, "obj", "gen", "head", F.col("node")["Contents"].alias("Contents")), [key, "obj"])


def page_boxes(pages: DataFrame) -> DataFrame:
    """pages with left, bottom, width, height and rotation; without a box of four numbers it is 612 x 792."""
    n = numbers(F.col("MediaBox"))
    box = F.when(F.size(n) == 4, n).otherwise(F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))
    low = lambda k: F.least(box[k], box[k + 2])
    size = lambda k: F.abs(box[k + 2] - box[k])
    turn = F.coalesce(F.decode("Rotate", "ISO-8859-1").try_cast("int"), F.lit(0))
    return pages.withColumns({"left": low(0), "bottom": low(1), "width": size(0), "height": size(1), "rotation": turn})


def layer(text: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, page, stream): the operators that show a page's runs invisibly; runs are (key, page, run, text, x, y, w, h)."""
    at = placement(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.char_length("text"), F.col("left"), F.col("bottom"), F.col("width"), F.col("height"), F.col("rotation"))
    turn = F.lit(TURNS[0])
    for angle in (90, 180, 270):
        turn = F.when(F.col("p.angle") == angle, TURNS[angle]).otherwise(turn)
    one = F.concat(
        F.lit(f"BT\n3 Tr\n/{FONT} "), number_text(F.col("p.size")), F.lit(" Tf\n"), number_text(F.col("p.scale")), F.lit(" Tz\n"), turn, F.lit(" "), number_text(F.col("p.x")),
        F.lit(" "), number_text(F.col("p.y")), F.lit(" Tm\n("), escaped(F.col("text")), F.lit(") Tj\nET\n"))
    rows = text.where(F.char_length("text") > 0).join(page_boxes(pages), [key, "page"]).withColumn("p", at).select(key, "page", "run", one.alias("one"))
    runs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "one"))), lambda r: r["one"]), "")
    return rows.groupBy(key, "page").agg(F.concat(F.lit("q\n"), runs, F.lit("Q")).alias("stream"))


@F.udf(StructType().add("body", BinaryType()).add("font", LongType()), useArrow=True)
def _with_font(resources: bytes | None, entry: str) -> dict | None:
    """A dictionary of resources that knows the font; or the object that holds its fonts; null if it cannot be read."""
    data, new = bytes(resources or b"<< >>"), entry.encode()
    found = spans(data)
    if found is None:
        return None
    if "Font" not in found[0]:
        return {"body": data[:2] + b" /Font << " + new + b" >>" + data[2:], "font": None}
    begin, end = found[0]["Font"]
    held = ref_of(data[begin:end])
    if held:
        return {"body": data, "font": held[0]}
    if values(data, begin) is None:
        return None
    return {"body": data[: end - 2] + b" " + new + b" " + data[end - 2 :], "font": None}


@F.udf(BinaryType(), useArrow=True)
def _with_entry(fonts: bytes | None, entry: str) -> bytes | None:
    data = bytes(fonts or b"")
    found = spans(data)
    return None if found is None else data[: found[1] - 2] + b" " + entry.encode() + b" " + data[found[1] - 2 : found[1]]


@F.udf(BinaryType(), useArrow=True)
def _page_with(head: bytes | None, stream: str, resources: bytes | None) -> bytes | None:
    """A page's dictionary with one more stream behind its contents and, if given, other resources; null if it cannot be read."""
    data = bytes(head or b"")
    found = spans(data)
    if found is None:
        return None
    edits, new = [], b""
    if "Contents" in found[0]:
        begin, end = found[0]["Contents"]
        old = data[begin:end].strip()
        if old.startswith(b"[") != old.endswith(b"]"):
            return None
        edits.append((begin, end, b"[ " + (old[1:-1].strip() if old.startswith(b"[") else old) + b" " + stream.encode() + b" ]"))
    else:
        new += b" /Contents [ " + stream.encode() + b" ]"
    if resources is not None:
        if "Resources" in found[0]:
            edits.append((*found[0]["Resources"], bytes(resources)))
        else:
            new += b" /Resources " + bytes(resources)
    for begin, end, value in sorted(edits, reverse=True):
        data = data[:begin] + value + data[end:]
    return data[:2] + new + data[2:]


def _latin(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "ISO-8859-1")


def _objects(told: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """(key, obj, gen, body): new and superseded objects; a null body is one that could not be made."""
    objects = told.where("obj IS NOT NULL").select(key, "obj", "gen", "head", (F.col("stream_start").isNotNull() | F.startswith("head", F.lit("<<").cast("binary"))).alias("whole"))
    pages = stage_rows(page_rows(told, key), "pages")
    ends = told.where("obj IS NULL").select(key, F.greatest("ending.largest", F.col("ending.size") - 1).alias("base"))
    wanted = text.where(F.char_length("text") > 0).select(key, "page").distinct()
    n = F.row_number().over(Window.partitionBy(key).orderBy("page"))
    targets = wanted.join(pages, [key, "page"], "left").join(ends, key).withColumn("stream", F.col("base") + 1 + n)
    entry = F.concat(F.lit(f"/{FONT} "), (F.col("base") + 1).cast("string"), F.lit(" 0 R"))
    first = F.when(F.size(references(F.col("Contents"))) == 1, reference(F.col("Contents")))
    targets = targets.withColumns({"entry": entry, "shared": reference(F.col("Resources")), "one": first})
    sound = objects.select(key, F.col("obj").alias("one"), F.col("whole").alias("one_whole"))
    targets = stage_rows(targets.join(sound, [key, "one"], "left"), "targets")

    own = targets.where("shared IS NULL").withColumn("made", _with_font("Resources", "entry"))
    held = targets.where("shared IS NOT NULL").select(key, F.col("shared").alias("obj"), "entry").distinct()
    held = held.join(objects.drop("whole"), [key, "obj"], "left").withColumn("made", _with_font("head", "entry"))
    resources = held.where("made IS NULL OR made.font IS NULL").select(key, "obj", F.coalesce("gen", F.lit(0).cast("long")).alias("gen"), F.when(F.col("head").isNotNull(), F.col("made.body")).alias("body"))
    lists = own.select(key, F.col("made.font").alias("obj"), "entry").unionByName(held.select(key, F.col("made.font").alias("obj"), "entry")).where("obj IS NOT NULL").distinct()
    lists = lists.join(objects.drop("whole"), [key, "obj"], "left").select(key, "obj", F.coalesce("gen", F.lit(0).cast("long")).alias("gen"), _with_entry("head", "entry").alias("body"))

    ready = own.select(*targets.columns, F.when(F.col("made.font").isNull(), F.col("made.body")).alias("new"), F.col("made").isNull().alias("bad")).unionByName(
        targets.where("shared IS NOT NULL").withColumns({"new": F.lit(None).cast("binary"), "bad": F.lit(False)}))
    odd = F.col("bad") | F.col("obj").isNull() | (F.col("one").isNotNull() & ~F.coalesce("one_whole", F.lit(False))) | (F.col("Contents").isNotNull() & F.col("one").isNull() & ~F.startswith(F.coalesce("Contents", F.lit("").cast("binary")), F.lit("[").cast("binary")))
    page = ready.select(key, F.coalesce("obj", F.lit(-1).cast("long")).alias("obj"), F.coalesce("gen", F.lit(0).cast("long")).alias("gen"), F.when(~odd, _page_with("head", F.concat(F.col("stream").cast("string"), F.lit(" 0 R")), "new")).alias("body"))
    shown = layer(text, pages, key).join(targets.select(key, "page", F.col("stream").alias("obj")), [key, "page"])
    data = F.encode("stream", "ISO-8859-1")
    zero = F.lit(0).cast("long")
    streams = shown.select(key, "obj", zero.alias("gen"), F.concat(_latin("<< /Length ", F.octet_length(data), " >>\nstream\n"), data, _latin("\nendstream")).alias("body"))
    font = targets.select(key, (F.col("base") + 1).alias("obj")).distinct().select(key, "obj", zero.alias("gen"), _latin(FONT_BODY).alias("body"))
    out = font.unionByName(streams).unionByName(page).unionByName(resources).unionByName(lists)
    return out.select(key, "obj", "gen", "body")


def _table(entries: DataFrame, key: str) -> DataFrame:
    """(key, rows, index, entries): a table of references in both forms, of (key, obj, gen, at)."""
    by = Window.partitionBy(key).orderBy("obj")
    runs = entries.withColumn("run", F.col("obj") - F.row_number().over(by))
    one = Window.partitionBy(key, "run")
    runs = runs.withColumns({"n": F.count(F.lit(1)).over(one), "first": F.min("obj").over(one)})
    wide = F.greatest(F.lit(1), F.ceil(F.length(F.hex(F.max("at").over(Window.partitionBy(key)))) / 2))
    head = F.col("obj") == F.col("first")
    runs = runs.withColumn("wide", wide.cast("int"))
    row = F.concat(F.when(head, F.concat_ws(" ", F.col("first").cast("string"), F.concat(F.col("n").cast("string"), F.lit("\n")))).otherwise(""), F.format_string("%010d %05d n \n", "at", "gen"))
    packed = F.unhex(F.concat(F.lit("01"), F.lpad(F.hex("at"), F.col("wide") * 2, F.lit("0")), F.lpad(F.hex("gen"), F.lit(4), F.lit("0"))))
    index = F.when(head, F.concat_ws(" ", F.col("first").cast("string"), F.concat(F.col("n").cast("string"), F.lit(" ")))).otherwise("")
    rows = runs.select(key, "obj", "wide", row.alias("row"), packed.alias("packed"), index.alias("index"))
    return rows.groupBy(key).agg(
        F.expr("listagg(row) WITHIN GROUP (ORDER BY obj)").alias("rows"), F.expr("listagg(index) WITHIN GROUP (ORDER BY obj)").alias("index"),
        F.expr("listagg(packed) WITHIN GROUP (ORDER BY obj)").alias("packed"), F.max("wide").alias("wide"), F.max("obj").alias("highest"))


def text_sections(files: DataFrame, text: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, status, section): what to append to each file so that its pages hold the text invisibly.

    text is (key, page, run, text, x, y, w, h): a run's box in shares of the page as shown, from its lower left corner.
    status is ok, unchanged (no text: nothing to append), unsupported (a page that is not there, or a structure that
    cannot be read: nothing is guessed), encrypted (open without a password, but new bytes would have to be encrypted
    too), or the file's own state (missing, corrupt, encrypted).  section is null unless ok.  Text
    outside Latin-1 is shown as `?`.  The table of references has the form that the file's last one has.  A file's
    new bytes are one value.
    """
    told = stage_rows(parsed(files, key, content), "parsed")
    ends = told.where("obj IS NULL").select(key, "ending")
    usable = told.join(ends.where("ending.state = 'open' AND NOT ending.encrypted").select(key), key, "left_semi")
    made = stage_rows(_objects(usable, text.join(ends.select(key), key, "left_semi"), key), "updates")
    bad = made.groupBy(key).agg(F.count_if(F.col("body").isNull()).alias("bad"))
    good = made.join(bad.where("bad = 0").select(key), key, "left_semi")
    length = ends.select(key, "ending.length")
    new = good.select(key, "obj", "gen", F.concat(_latin(F.col("obj"), " ", F.col("gen"), " obj\n"), F.col("body"), _latin("\nendobj\n")).alias("bytes"))
    before = Window.partitionBy(key).orderBy("obj").rowsBetween(Window.unboundedPreceding, -1)
    new = new.join(length, key).withColumn("at", F.col("length") + 1 + F.coalesce(F.sum(F.octet_length("bytes")).over(before), F.lit(0)))
    bodies = new.groupBy(key).agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY obj)").alias("bodies"), F.max("obj").alias("top"))
    whole = bodies.join(ends, key)
    whole = whole.select(
        key, "bodies", (F.col("ending.length") + 1 + F.octet_length("bodies")).alias("place"), F.greatest("top", "ending.largest", F.col("ending.size") - 1).alias("top"),
        "ending.form", "ending.startxref", F.concat_ws(" ", F.col("ending.root").cast("string"), F.col("ending.root_gen").cast("string"), F.lit("R")).alias("root"))
    whole = stage_rows(whole, "sections")
    zero = F.lit(0).cast("long")
    itself = whole.where("form = 'stream'").select(key, (F.col("top") + 1).alias("obj"), zero.alias("gen"), F.col("place").alias("at"))
    tables = _table(new.select(key, "obj", "gen", "at").unionByName(itself), key)
    out = whole.join(tables, key)
    size = F.greatest("top", "highest") + 1
    names = F.concat(F.lit("/Size "), size.cast("string"), F.lit(" /Root "), F.col("root"), F.lit(" /Prev "), F.col("startxref").cast("string"))
    table = _latin("xref\n", F.col("rows"), "trailer\n<< ", names, " >>\n")
    stream = F.concat(
        _latin(F.col("top") + 1, " 0 obj\n<< /Type /XRef ", names, " /W [ 1 ", F.col("wide"), " 2 ] /Index [ ", F.rtrim("index"), " ] /Length ", F.octet_length("packed"), " >>\nstream\n"),
        F.col("packed"), _latin("\nendstream\nendobj\n"))
    tail = _latin("startxref\n", F.col("place"), "\n%%EOF\n")
    sections = out.select(key, F.concat(_latin("\n"), F.col("bodies"), F.when(F.col("form") == "stream", stream).otherwise(table), tail).alias("section"))
    asked = text.where(F.char_length("text") > 0).select(key).distinct().withColumn("asked", F.lit(True))
    states = ends.join(asked, key, "left").join(sections, key, "left")
    status = (
        F.when(F.col("ending.state") != "open", F.col("ending.state")).when(F.col("asked").isNull(), "unchanged")
        .when(F.col("ending.encrypted"), "encrypted").when(F.col("section").isNull(), "unsupported").otherwise("ok")
    )
    return states.select(key, status.alias("status"), "section")


def page_streams(told: DataFrame, key: str) -> DataFrame:
    """Pages of parsed(contents=True) files with their box, fonts and the bytes of all their streams, one after the other."""
    pages = stage_rows(page_boxes(page_rows(told, key)), "pages")
    objects = told.where("obj IS NOT NULL")
    # a reference to an array of streams stands for the array
    single = pages.select(key, "page", reference(F.col("Contents")).alias("obj")).join(objects.where("stream_start IS NULL").select(key, "obj", "head"), [key, "obj"])
    lists = pages.join(single.select(key, "page", F.col("head").alias("listed")), [key, "page"], "left").select(key, "page", F.posexplode(references(F.coalesce("listed", "Contents"))).alias("k", "r"))
    parts = lists.select(key, "page", "k", F.col("r.obj").alias("obj")).join(objects.select(key, "obj", F.concat("plain", F.lit("\n").cast("binary")).alias("plain")), [key, "obj"])
    streams = parts.groupBy(key, "page").agg(F.expr("listagg(plain) WITHIN GROUP (ORDER BY k)").alias("stream"))
    return pages.join(streams, [key, "page"], "left").join(page_fonts(pages, objects, key), [key, "page"], "left")


def page_fonts(pages: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """(key, page, fonts): first codes and widths, in ems, of the fonts that pages name and that have widths."""
    heads = objects.select(key, "obj", "head")

    def resolved(rows: DataFrame, value: str) -> DataFrame:
        at = rows.withColumn("obj", reference(F.col(value))).join(heads, [key, "obj"], "left")
        return at.withColumn(value, F.coalesce("head", value)).drop("obj", "head")

    at = resolved(pages.select(key, "page", F.col("Resources").alias("value")), "value")
    at = resolved(at.select(key, "page", dictionary(F.col("value"))["Font"].alias("value")).where("value IS NOT NULL"), "value")
    at = resolved(at.select(key, "page", F.explode(dictionary(F.col("value"))).alias("name", "value")), "value")
    at = at.withColumn("d", dictionary(F.col("value"))).select(key, "page", "name", F.decode(F.col("d")["FirstChar"], "ISO-8859-1").try_cast("int").alias("first"), F.col("d")["Widths"].alias("value"))
    at = resolved(at.where("value IS NOT NULL"), "value")
    widths = F.transform(numbers(F.col("value")), lambda x: x / 1000)
    return at.groupBy(key, "page").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.coalesce("first", F.lit(0)).alias("first"), widths.alias("widths"))))).alias("fonts"))


def file_runs(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Positioned runs of all pages of files: see content.positioned_runs()."""
    told = stage_rows(parsed(files, key, content, contents=True), "parsed")
    return positioned_runs(page_streams(told, key), key, fonts="fonts")
