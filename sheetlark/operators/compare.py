"""What changed between two versions of a workbook.

``changes``: pair_id, category, sheet, ref, old, new. Any two sets of facts can be compared; a
pair names the path of the version sent and that of the version returned. :func:`cells` keys
cells by sheet and address; :func:`changes` first matches renamed sheets and the rows of a sheet by
what they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formulas import reference, relative, tokens
from ..sources.shared import written
from . import ranges
from .align import aligned_rows
from .asof import asof
from .findings import windows_user
from .sheets import matched_sheets, with_new_names

CAVEAT_SAVER = "Nome gravado por quem salvou por último; pode ser editado, e abrir sem salvar não deixa rastro."
CAVEAT_USER = "O mesmo usuário do Windows nas duas versões é indício, não prova, de autoria comum."


def pairs(spark: SparkSession, *paths: tuple[str, str]) -> DataFrame:
    """A table of the given paths, broadcast in joins: facts of a few paths stay dealt out as they are."""
    return F.broadcast(spark.createDataFrame([(f"{old} -> {new}", old, new) for old, new in paths], "pair_id string, old_path string, new_path string"))


def sided(facts: DataFrame, pairs_: DataFrame) -> DataFrame:
    """Facts of both versions with ``pair_id`` and ``side``, old or new."""
    each = F.array(*(F.struct(F.col(f"{side}_path").alias("path"), F.lit(side).alias("side")) for side in ("old", "new")))
    return facts.join(pairs_.select("pair_id", F.explode(each).alias("p")).select("pair_id", "p.*"), "path").drop("path")


def both(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two sets of facts with ``pair_id`` as one with ``side``."""
    return old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))


#: What a fact is compared by within its pair and sheet, and kinds that are told under another's name.
_KEYS = {"cell": "ref", "sheet": "sheet", "link": "value", "prop": "name", "error": "name"}
_AXES = ("hidden_row", "hidden_col", "hidden_rest")
BY = ["pair_id", "kind", "sheet", "key"]
NONE = "\0"  # stands for null among keys; no text of a workbook can hold it


def _keyed(facts: DataFrame) -> DataFrame:
    """Facts with the key that they are compared by; ``form`` is a formula relative to its cell, where that is known."""
    kind, key = F.col("kind"), None
    for k, c in _KEYS.items():
        key = F.when(kind == k, F.col(c)) if key is None else key.when(kind == k, F.col(c))
    sheet = F.when(~kind.isin("link", "prop"), F.col("sheet")).alias("sheet")
    formula = F.when(kind == "cell", F.col("formula")).alias("formula")
    form = F.when(kind == "cell", F.col("form") if "form" in facts.columns else relative()).alias("form")
    return facts.where(kind.isin(*_KEYS)).select("pair_id", "side", "kind", sheet, key.alias("key"), "value", formula, form)


def _matches(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= left[n].eqNullSafe(right[n])
    return out


def differences(facts: DataFrame) -> DataFrame:
    """Where the two sides of ``facts`` differ: pair_id, kind, sheet, key, what each side holds.

    Each side is dealt out by its keys and sorted once; both the choice among repeated keys and the join
    go by that order. Facts that repeat a key on one side count once, with the greatest value and then formula.
    """
    rows = _keyed(facts)
    # plain keys that are never null, the one that tells most rows apart first: window and join share one exchange and one sort
    put = lambda c: F.coalesce(F.col(c), F.lit(NONE)).alias(f"_{c}")
    plain = [f"_{c}" for c in reversed(BY)]
    own = Window.partitionBy(*plain).orderBy(F.desc("value"), F.desc("formula"))

    def of(side: str) -> DataFrame:
        one = rows.where(F.col("side") == side).select(*map(put, BY), "value", "formula", "form")
        first = F.lag(F.lit(1)).over(own).isNull()
        held = [F.col(c).alias(f"{c}_{side}") for c in ("value", "formula", "form")]
        return one.withColumn("first", first).where("first").select(*plain, F.lit(True).alias(f"in_{side}"), *held)

    met = of("old").join(of("new"), plain, "full_outer")
    back = [F.nullif(f"_{c}", F.lit(NONE)).alias(c) for c in BY]
    held = [F.coalesce(f"in_{s}", F.lit(False)).alias(f"in_{s}") for s in ("old", "new")]
    held += [F.col(f"{c}_{s}") for c in ("value", "formula", "form") for s in ("old", "new")]
    same = F.col("in_old") & F.col("in_new") & F.col("value_old").eqNullSafe(F.col("value_new")) & F.col("form_old").eqNullSafe(F.col("form_new"))
    return met.select(*back, *held).where((F.col("kind") == "error") | ~same)


def _categories(d: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row per category that a difference falls in: pair_id, category, sheet, ref, old, new. Without ``kinds``, all."""
    kind, was, now = F.col("kind"), F.col("in_old"), F.col("in_new")
    here = was & now
    value, formula = (~F.col(f"{x}_old").eqNullSafe(F.col(f"{x}_new")) for x in ("value", "form"))
    constant = here & F.col("formula_old").isNotNull() & F.col("formula_new").isNull() & F.col("value_new").isNotNull()
    told = lambda category, old="value_old", new="value_new": F.struct(F.lit(category).alias("category"), F.col(old).alias("old"), F.col(new).alias("new"))
    cell = lambda: [(~was, told("cell_added")), (~now, told("cell_removed")), (here & value, told("value_changed")), (constant, told("formula_to_constant", "formula_old")), (here & formula & ~constant, told("formula_changed", "formula_old", "formula_new"))]
    sheet = lambda: F.when(~was, told("sheet_added")).when(~now, told("sheet_removed")).when(F.col("value_new") == "visible", told("sheet_shown")).when(F.col("value_old") == "visible", told("sheet_hidden")).otherwise(told("sheet_state"))
    of_kind = {
        "cell": lambda: F.array_compact(F.array(*(F.when(c, t) for c, t in cell()))),
        "sheet": lambda: F.array(sheet()),
        "link": lambda: F.array(F.when(now, told("link_added")).otherwise(told("link_removed"))),
        "prop": lambda: F.array(told("metadata_changed")),
        "error": lambda: F.array(told("unreadable")),
    }
    tagged = None
    for k, make in of_kind.items():
        if not kinds or k in kinds:
            tagged = F.when(kind == k, make()) if tagged is None else tagged.when(kind == k, make())
    ref = F.when(~kind.isin("sheet", "link"), F.col("key"))
    return d.select("pair_id", "sheet", ref.alias("ref"), F.explode(tagged).alias("t")).select("pair_id", "t.category", "sheet", "ref", "t.old", "t.new")


def _of(kinds: tuple[str, ...], old: DataFrame, new: DataFrame) -> DataFrame:
    return _categories(differences(both(old, new).where(F.col("kind").isin(*kinds))), kinds)


def cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells by sheet and address; see :func:`aligned_cells` for rows that stand elsewhere."""
    return _of(("cell",), old, new)


def sheets(old: DataFrame, new: DataFrame) -> DataFrame:
    return _of(("sheet",), old, new)


def links(old: DataFrame, new: DataFrame) -> DataFrame:
    return _of(("link",), old, new)


def metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    return _of(("prop",), old, new)


# ---------------------------------------------------------------- hidden rows and columns, as ranges


def hidden_ranges(facts: DataFrame) -> DataFrame:
    """Ranges of rows and columns that became hidden, or visible again: pair_id, kind, sheet, in_new, lo, hi.

    ``hidden_rest`` (all rows that a sheet does not write) has the bounds 0 and 0.
    """
    kind, rest = F.col("kind"), F.col("kind") == "hidden_rest"
    bound = lambda c: F.when(rest, 0).otherwise(F.col(c)).cast("long")
    axes_ = facts.where(kind.isin(*_AXES)).select("pair_id", "side", F.when(rest, "hidden_row").otherwise(kind).alias("kind"), F.coalesce("sheet", F.lit("")).alias("sheet"), bound("row").alias("lo"), bound("col").alias("hi"))
    # rows are numbered from 1; the mark keeps 0 from joining them
    return ranges.apart(axes_.withColumn("rest", F.col("lo") == 0), ["pair_id", "kind", "sheet", "rest"]).drop("rest")


def _axis_changes(found: DataFrame) -> DataFrame:
    name = F.when(F.col("kind") == "hidden_row", "row").otherwise("column")
    category = F.concat(name, F.when(F.col("in_new"), "_hidden").otherwise("_shown"))
    ref = F.when(F.col("hi") == 0, "*").otherwise(ranges.named(F.col("lo"), F.col("hi")))
    none = F.lit(None).cast("string")
    return found.select("pair_id", category.alias("category"), F.nullif("sheet", F.lit("")).alias("sheet"), ref.alias("ref"), none.alias("old"), none.alias("new"))


def axes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows and columns that became hidden, or visible again; neighbours are one range, such as ``4:9``."""
    return _axis_changes(hidden_ranges(both(old, new)))


# ---------------------------------------------------------------- parts that could not be read

#: Kinds of facts that cannot be compared where a part is unreadable; an error without a name is a whole file.
_HIDDEN = ("hidden_row", "hidden_col")
MISSED = {"properties": ("prop",), "links": ("link",), "sheets": ("sheet", "cell", *_HIDDEN), "shared_strings": ("cell",), "sheet": ("cell", *_HIDDEN)}


def lost(facts: DataFrame) -> DataFrame:
    """``(pair_id, kind, sheet)`` that an unreadable part of either side hides; an empty sheet stands for all. A few rows per error."""
    kinds = F.when(F.col("name").isNull(), F.array(*map(F.lit, ("prop", "link", *MISSED["sheets"]))))
    for name, missed in MISSED.items():
        kinds = kinds.when(F.col("name") == name, F.array(*map(F.lit, missed)))
    return facts.where("kind = 'error'").select("pair_id", F.explode(kinds).alias("kind"), F.coalesce("sheet", F.lit("")).alias("sheet")).distinct()


def readable(d: DataFrame, lost_: DataFrame) -> DataFrame:
    """Differences without those that an unreadable part of one side would make look added or removed.

    What is lost is a few rows per error and is broadcast; dealt out by pair and kind, all cells of a pair would be one task's.
    """
    whole = F.broadcast(lost_.where("sheet = ''").select("pair_id", "kind"))
    one = F.broadcast(lost_.where("sheet <> ''").withColumnRenamed("sheet", "lost_sheet"))
    left = d.join(whole, ["pair_id", "kind"], "left_anti")
    return left.join(one, (left["pair_id"] == one["pair_id"]) & (left["kind"] == one["kind"]) & (left["sheet"] == one["lost_sheet"]), "left_anti")


# ---------------------------------------------------------------- all changes


def _placed(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts whose cells of the old side are addressed by the row that matches theirs; cells of rows without a match go.

    What an old cell's formula is relative to stays its own row.
    """
    went = rows.where("new_row IS NULL OR new_row <> old_row").where("old_row IS NOT NULL").select("pair_id", "sheet", F.lit("old").alias("side"), F.col("old_row").alias("row"), F.col("new_row").alias("to"), F.lit(True).alias("listed"))
    came = rows.where("old_row IS NULL").select("pair_id", "sheet", F.lit("new").alias("side"), F.col("new_row").alias("row"), F.lit(None).cast("int").alias("to"), F.lit(True).alias("listed"))
    other, cell_ = facts.where("kind <> 'cell'"), facts.where("kind = 'cell'")
    met = cell_.join(went.unionByName(came), ["pair_id", "sheet", "side", "row"], "left")
    ref = F.when(F.col("listed"), F.concat(F.regexp_extract("ref", "^[A-Za-z]+", 0), F.col("to").cast("string"))).otherwise(F.col("ref"))
    return met.where("listed IS NULL OR to IS NOT NULL").withColumn("ref", ref).select(*facts.columns).unionByName(other)


def _row_changes(rows: DataFrame) -> DataFrame:
    """Rows that were added, removed or moved; ``ref`` is where a row stands now, or stood."""
    category = F.when(F.col("old_row").isNull(), "row_added").when(F.col("new_row").isNull(), "row_removed").when(F.col("moved"), "row_moved")
    text = lambda c: F.when(F.col("moved"), F.col(c).cast("string"))
    return rows.where(category.isNotNull()).select("pair_id", category.alias("category"), "sheet", F.coalesce("new_row", "old_row").cast("string").alias("ref"), text("old_row").alias("old"), text("new_row").alias("new"))


def _followed(d: DataFrame, rows: DataFrame, renamed: DataFrame) -> DataFrame:
    """Differences whose formulas say the same once every reference of the old one follows the row that it names.

    Of formulas that differ in more than that, nothing is looked up. A reference to a row that has no match goes by
    the last matched row above it, as of that place.
    """
    key = ["pair_id", "sheet", "key"]
    differs = d.where("kind = 'cell' AND formula_old IS NOT NULL AND formula_new IS NOT NULL AND NOT (form_old <=> form_new)")
    pair = differs.select(*key, tokens("formula_old").alias("a"), tokens("formula_new").alias("b")).where(F.size("a") == F.size("b"))
    each = pair.select(*key, "a", F.posexplode(F.arrays_zip("a", "b")).alias("i", "t"))
    at = lambda k: F.when(F.col("i") >= k, F.get("a", F.col("i") - k))
    # a sheet's name is one token with its sign, in quotes or not
    plain = lambda t: F.left(t, F.length(t) - 1)
    bare = lambda t: F.when(t.startswith("'"), F.replace(F.substring(t, 2, F.length(t) - 3), F.lit("''"), F.lit("'"))).otherwise(plain(t))
    sheet = F.when(at(1).endswith("!"), bare(at(1))).when((at(1) == ":") & at(3).endswith("!"), bare(at(3))).otherwise(F.col("sheet"))
    names_sheet = F.col("t.a").endswith("!")
    each = each.select(*key, F.col("t.a").alias("a"), F.col("t.b").alias("b"), reference("t.a").alias("x"), reference("t.b").alias("y"), sheet.alias("there"), names_sheet.alias("names"))
    renamed_ = renamed.select(F.col("pair_id").alias("p"), F.col("old_sheet"), F.col("new_sheet"))
    each = each.join(renamed_, (F.col("pair_id") == F.col("p")) & (bare(F.col("a")) == F.col("old_sheet")) & F.col("names"), "left")
    same_name = F.when(F.col("new_sheet").isNotNull() & F.col("b").endswith("!"), F.col("new_sheet") == bare(F.col("b"))).otherwise(F.col("a") == F.col("b"))
    shape = lambda c: F.struct(f"{c}.fixed_column", f"{c}.column", f"{c}.fixed_row")
    fits = F.when(F.col("x").isNull(), F.col("y").isNull() & same_name).otherwise(F.coalesce(shape("x") == shape("y"), F.lit(False)))
    refs = each.select(*key, fits.alias("fits"), "there", F.col("x.row").alias("at"), F.col("y.row").alias("to"))
    # the sheet that a reference names goes by its new name, as the matched rows do
    now = renamed.select(F.col("pair_id").alias("p"), F.col("old_sheet").alias("there_old"), F.col("new_sheet").alias("there_new"))
    refs = refs.join(now, (F.col("pair_id") == F.col("p")) & (F.col("there") == F.col("there_old")), "left").withColumn("there", F.coalesce("there_new", "there")).drop("p", "there_old", "there_new")
    matched = rows.where("old_row IS NOT NULL AND new_row IS NOT NULL AND NOT moved").select("pair_id", F.col("sheet").alias("there"), F.col("old_row").alias("at"), (F.col("new_row") - F.col("old_row")).alias("by"))
    led = asof(refs, matched, ["pair_id", "there"], "at", ["by"], width=1 << 16)
    good = F.col("fits") & (F.col("at").isNull() | (F.col("at") + F.coalesce("by", F.lit(0)) == F.col("to")))
    same = led.groupBy(*key).agg(F.bool_and(good).alias("same")).where("same")
    out = d.join(same, (d["kind"] == "cell") & _matches(d, same, key), "left").select(d["*"], "same")
    out = out.withColumn("form_old", F.when(F.col("same"), F.col("form_new")).otherwise(F.col("form_old"))).drop("same")
    return out.where((F.col("kind") != "cell") | ~(F.col("in_old") & F.col("in_new") & F.col("value_old").eqNullSafe(F.col("value_new")) & F.col("form_old").eqNullSafe(F.col("form_new"))))


def aligned_cells(facts: DataFrame, rows: DataFrame, renamed: DataFrame) -> DataFrame:
    """Differences of all kinds but axes, where ``rows`` (from :func:`align.aligned_rows`) match the rows of both sides."""
    return _followed(written(differences(_placed(facts, rows)), "differences"), rows, renamed)


def changes(facts: DataFrame, pairs_: DataFrame) -> DataFrame:
    """All changes of all pairs. Files are opened once: what they say is written, and read from there.

    Rows are matched by what they hold, so an inserted row is one ``row_added`` and cells are told by where they
    stand now. A sheet that another name holds nearly the same of is one ``sheet_renamed``.
    """
    known = written(sided(facts, pairs_).withColumn("form", relative()), "facts")
    gone = lost(known)
    renamed = written(matched_sheets(known), "sheets")
    if not renamed.isEmpty():
        known = with_new_names(known, renamed)
    rows = written(aligned_rows(readable(known.where("kind = 'cell'"), gone)), "rows")
    if renamed.isEmpty() and rows.where("NOT (old_row <=> new_row)").isEmpty():  # every sheet and row is where it was
        found, hidden = differences(known), known
    else:
        found, hidden = aligned_cells(known, rows, renamed), followed_ranges(known, rows)
    out = _categories(readable(found, gone)).unionByName(_axis_changes(readable(hidden_ranges(hidden), gone)))
    return out.unionByName(_row_changes(rows)).unionByName(_sheet_changes(renamed))


def followed_ranges(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts whose hidden rows of the old side stand where their rows stand now; those of removed rows go."""
    hidden = facts.where("kind = 'hidden_row' AND side = 'old'").withColumn("at", F.col("row"))
    matched = rows.where("old_row IS NOT NULL AND NOT moved").select("pair_id", "sheet", F.col("old_row").alias("at"), (F.coalesce("new_row", F.lit(0)) - F.col("old_row")).alias("by"), F.col("new_row").isNull().alias("gone"))
    led = asof(hidden, matched.where("NOT gone"), ["pair_id", "sheet"], "at", ["by"], width=1 << 16)
    led = led.withColumns({"row": F.col("row") + F.coalesce("by", F.lit(0)), "col": F.col("col") + F.coalesce("by", F.lit(0))})
    removed = matched.where("gone").select("pair_id", "sheet", "at")
    one = led.join(removed.withColumn("single", F.lit(True)), ["pair_id", "sheet", "at"], "left").where("single IS NULL OR row <> col")
    return one.select(*facts.columns).unionByName(facts.where("kind IN ('hidden_col', 'hidden_rest') OR (kind = 'hidden_row' AND side = 'new')"))


def _sheet_changes(renamed: DataFrame) -> DataFrame:
    return renamed.select("pair_id", F.lit("sheet_renamed").alias("category"), F.col("new_sheet").alias("sheet"), F.lit(None).cast("string").alias("ref"), F.col("old_sheet").alias("old"), F.col("new_sheet").alias("new"))


def provenance(facts: DataFrame, pairs_: DataFrame) -> DataFrame:
    """Who saved last, where each version was saved, and whether the Windows user is the same: a hint, never a proof."""
    known = sided(facts.where("kind = 'prop' AND name IN ('lastModifiedBy', 'save_folder')").select("path", "name", "value"), pairs_)
    pick = lambda n, side: F.max(F.when((F.col("name") == n) & (F.col("side") == side), F.col("value")))
    wide = known.groupBy("pair_id").agg(*(pick(n, side).alias(f"{c}_{side}") for side in ("old", "new") for n, c in (("lastModifiedBy", "saved_by"), ("save_folder", "folder"))))
    out = pairs_.select("pair_id").join(wide, "pair_id", "left")
    same = F.lower(windows_user(F.col("folder_old"))) == F.lower(windows_user(F.col("folder_new")))
    return out.withColumn("same_windows_user_hint", F.coalesce(same, F.lit(False))).withColumn("caveat", F.lit(f"{CAVEAT_SAVER} {CAVEAT_USER}"))
