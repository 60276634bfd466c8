"""Benchmark decontamination by templates, in DataFrame operations only.

Words are made canonical: a number, a unit of measure after a number and a capitalised word become typed placeholders,
other words lose case and closing punctuation. Every run of ``WINDOW`` canonical words of a document is hashed and joined
with the runs of the benchmark items, so a question that was asked anew with other numbers or names still meets its
item. A capitalised word that begins a sentence may be a name or not, and a word that begins a sentence in the item may stand
in lower case in a copy: the item's runs, a small table, are hashed in every form of such words; a document's words have
one form, so a document has one row for each of its words, which carries the hashes of a run's words and no text. What
fills the slots is then compared: laid over an item at one place, each filling of the item
must stand for one and the same filling in the document, or the place doesn't count. A document is contaminated by an
item if the places that count hold at least ``CONTAINED`` of the item's runs.

Items of fewer than ``WINDOW`` words, or without a run of at least ``PLAIN`` ordinary words, are no templates: they are looked
for word for word, short ones whole and long ones by their runs.

The benchmark's runs are broadcast while there are at most ``BROADCAST_RUNS`` of them, which is counted; beyond that
they are joined by a shuffle.

Defined results: no text counts as empty; rows and items without an id, and items without a word that is more than closing marks, are left out; repeated rows count once; other columns are left out; an empty
table on either side gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.shared import written

WINDOW = 5
PLAIN = 2
CONTAINED = 0.8
CONSISTENT = 0.8
BROADCAST_RUNS = 1_000_000

BREAKS = r'[\s,;:()\[\]{}"]+'
CLOSING = ".!?"
SIGNS = "$€£+-#"
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometers", "kilometres", "mg", "g", "kg", "t", "gram", "grams", "kilograms",
    "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur",
    "percent", "degrees", "watts", "volts", "kb", "mb", "gb", "tb",
]
# Placeholders hold a character that no canonical word has.
NUMBER, UNIT, NAME = "\u0001number", "\u0001unit", "\u0001name"


def _is_number(word: Column) -> Column:
    return F.ascii(F.ltrim(word, F.lit(SIGNS))).between(48, 57)


def _capital(word: Column) -> Column:
    low = F.lower(F.rtrim(word, F.lit(CLOSING)))
    return (F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1))) & (low != word) & (F.upper(word) != word)


def _opens(last: Column) -> Column:
    """Whether a word after ``last`` begins a sentence."""
    return last.isNull() | (F.length(F.rtrim(last, F.lit(CLOSING))) < F.length(last))


def plain(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(CLOSING)))


def canonical(word: Column, last: Column) -> Column:
    """The canonical form of a word after another one."""
    low = plain(word)
    after_number = F.coalesce(_is_number(last), F.lit(False))
    return (
        F.when(_is_number(word), NUMBER)
        .when(after_number & F.array_contains(F.array(*[F.lit(u) for u in UNITS]), low), UNIT)
        .when(F.ascii(word).between(97, 122), low)
        .when(_capital(word), NAME)
        .otherwise(low)
    )


def _words(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, version, words): rows with the same id and other texts differ in ``version``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(whole).alias("version"),
        F.filter(F.split(whole, BREAKS), lambda w: w != "").alias("words"))


def _hashes(exact: bool) -> Column:
    if exact:
        return F.transform("words", lambda w: F.xxhash64(plain(w)))
    return F.transform("words", lambda w, i: F.xxhash64(canonical(w, F.get(F.col("words"), i - 1))))


def _places(size: Column, window: int) -> Column:
    return F.when(size >= window, F.sequence(F.lit(0), size - window)).otherwise(F.array().cast("array<int>"))


def document_runs(docs: DataFrame, key: str, window: int, exact: bool = False) -> DataFrame:
    """(id, version, pos, run, seen): one hash for each place of a document, of canonical or of plain words, and the
    hashes of the words that stand there (of canonical runs only)."""
    run = lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(window)])
    words = _words(docs, key)
    if exact:
        return words.select("id", "version", _hashes(True).alias("hashes")).select(
            "id", "version", F.posexplode(F.transform(_places(F.size("hashes"), window), run)).alias("pos", "run"))
    return (
        words.select("id", "version", _hashes(False).alias("hashes"), _hashes(True).alias("plain"))
        .select("id", "version", F.posexplode(F.transform(_places(F.size("hashes"), window), lambda i: F.struct(
            run(i).alias("run"), F.slice("plain", i + 1, F.lit(window)).alias("seen")))).alias("pos", "at"))
        .select("id", "version", "pos", "at.run", "at.seen")
    )


def item_runs(items: DataFrame, window: int) -> DataFrame:
    """(item_id, item_pos, plain, run, slots): each run of an item in every form that a copy may have, ``slots`` the places
    of its placeholders in it with the hash of what fills them."""
    word = lambda i: F.get(F.col("words"), i)
    # Words that may or may not be a name in a copy: those that begin a sentence, if they are no number or unit.
    forms = (
        items.withColumn("forms", F.transform("words", lambda w, i: canonical(w, word(i - 1))))
        .withColumn("open", F.transform("words", lambda w, i: (
            _opens(word(i - 1)) & ((F.ascii(F.get("forms", i)) != 1) | (F.get("forms", i) == NAME))).cast("int")))
    )
    bits = lambda i: sum((F.get("open", i + k) * F.lit(1 << k) for k in range(window)), F.lit(0))
    subsets = F.filter(F.array(*[F.lit(m) for m in range(1 << window)]), lambda m: m.bitwiseAND(F.col("bits")) == m)
    form = lambda k: (
        F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) == 0, F.get("forms", F.col("item_pos") + k))
        .when(F.col("named").bitwiseAND(F.lit(1 << k)) != 0, NAME).otherwise(plain(word(F.col("item_pos") + k))))
    slots = F.filter(F.array(*[
        F.when(F.ascii(form(k)) == 1, F.struct(F.lit(k).alias("at"), F.xxhash64(plain(word(F.col("item_pos") + k))).alias("filling")))
        for k in range(window)]), lambda s: s.isNotNull())
    ordinary = sum(((F.ascii(form(k)) != 1).cast("int") for k in range(window)), F.lit(0))
    return (
        forms.select("item_id", "words", "forms", "open", F.explode(_places(F.size("words"), window)).alias("item_pos"))
        .withColumn("bits", bits(F.col("item_pos")))
        .withColumn("named", F.explode(subsets))
        .select("item_id", "item_pos", ordinary.alias("plain"), F.xxhash64(*[F.xxhash64(form(k)) for k in range(window)]).alias("run"),
                slots.alias("slots"))
    )


def _met(docs: DataFrame, key: str, wanted: DataFrame, window: int, exact: bool = False) -> DataFrame:
    small = wanted.count() <= BROADCAST_RUNS
    return document_runs(docs, key, window, exact).join(F.broadcast(wanted) if small else wanted, "run").drop("run")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id",
                 window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, contained, changed): documents that hold an item, the share of its runs that they hold, and
    whether slots are filled differently."""
    items = _words(benchmark, item).where(F.exists("words", lambda w: plain(w) != "")).select(F.col("id").alias("item_id"), "words").distinct()
    wanted = written(item_runs(items, window).where(F.col("plain") >= PLAIN).drop("plain").distinct(), "templates")
    totals = wanted.groupBy("item_id").agg(F.countDistinct("item_pos").alias("total"))
    met = written(_met(docs, key, wanted, window).withColumn("shift", F.col("pos") - F.col("item_pos")).drop("pos"), "templates-met")
    place = ["id", "version", "item_id", "shift"]
    # What stands in the slots; equal words are told by their hashes.
    slots = (
        met.select(*place, "seen", F.explode("slots").alias("slot"))
        .select(*place, F.col("slot.filling").alias("filled"), F.get("seen", F.col("slot.at")).alias("filling"))
        .groupBy(*place, "filled").agg(F.min("filling").alias("low"), F.max("filling").alias("high"))
        .groupBy(*place).agg(
            F.avg((F.col("low") == F.col("high")).cast("double")).alias("consistent"),
            F.max((F.col("low") != F.col("filled")) | (F.col("high") != F.col("filled"))).alias("changed"))
    )
    share = lambda met, totals: (
        met.groupBy("id", "version", "item_id", "item_pos").agg(F.min("changed").alias("changed"))
        .groupBy("id", "version", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("changed").alias("changed"))
        .join(totals, "item_id").withColumn("contained", F.col("n") / F.col("total"))
        .where(F.col("contained") >= CONTAINED).select("id", "item_id", "contained", "changed"))
    found = share(
        met.select(*place, "item_pos").join(slots, place, "left")
        .where(F.coalesce(F.col("consistent") >= CONSISTENT, F.lit(True)))
        .select("id", "version", "item_id", "item_pos", F.coalesce("changed", F.lit(False)).alias("changed")), totals)

    # Items that are no templates, word for word.
    odd = written(items.join(totals, "item_id", "left_anti"), "templates-odd")
    for size in [r["size"] for r in odd.select(F.least(F.size("words"), F.lit(window)).alias("size")).distinct().orderBy("size").collect()]:
        own = odd.where(F.size("words") == size if size < window else F.size("words") >= window)
        at = lambda i, size=size: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(size)])
        exact = own.select("item_id", _hashes(True).alias("hashes")).select("item_id", "hashes", F.explode(
            _places(F.size("hashes"), size)).alias("item_pos")).select("item_id", "item_pos", at(F.col("item_pos")).alias("run")).distinct()
        exact = written(exact, "templates-exact")
        word_for_word = _met(docs, key, exact, size, True).select("id", "version", "item_id", "item_pos", F.lit(False).alias("changed"))
        found = found.unionByName(share(word_for_word, exact.groupBy("item_id").agg(F.countDistinct("item_pos").alias("total"))))
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("contained").alias("contained"), F.min("changed").alias("changed"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = written(contaminated(docs, benchmark).select("doc_id").distinct(), "templates-found")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
