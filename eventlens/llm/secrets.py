r"""Secret scans with corpus-wide ownership frequency, as SQL functions only.

Base spans per kind are the leftmost matches that don't overlap, found by splitting the text at the
pattern: the lengths of the pieces and of the matches give the offsets, in code points. Matches
that are too short are dropped after they took their characters.

Every base value and every further candidate (a token of 20 or more characters that looks live, see looks_live, and overlaps no
base span) is hashed. Hashes are counted by distinct owners and repositories over the whole corpus: distinct (hash, owner,
repository) first, so a value that a third of all rows hold is summed before it is shuffled to one place. A value of `widely`
or more owners, or of `copied` or more repositories whoever owns them, is an example that was copied about; any other is taken
for live. Only the hashes of copied values go back to the rows, and those that very many rows hold are broadcast (lookup).
Live candidates are added to the spans; base spans stay whatever their frequency, and each span says which it is.

Null and empty texts have no spans. A null owner or repository counts as none. Copies of a row count
once per repository. Ties at a start follow the order of the kinds. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import cut, lookup

ASSIGN = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: kind, pattern, group of the value, least characters of that group, a cheap test that texts without a match fail.
KINDS = [
    ("assign", ASSIGN, 1, 6, r"[sS][wW]|[eE][tT]|[eE][nN]|[eE][yY]"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
]
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}=*"
ORDER = ["assign", "access", "hex", "token"]
#: Owners, and repositories, from which on a value is a widely copied one.
WIDELY, COPIED = 3, 10


#: Least changes between letters and digits, and least distinct characters, of a token that looks live.
CHANGES, DISTINCT = 4, 10


def looks_live(value: Column) -> Column:
    """Letters and digits in turn and many different characters, as in random keys, not in paths, slugs, names or dates."""
    changes = F.regexp_count(value, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
    return (changes >= CHANGES) & (F.size(F.array_distinct(F.split(F.rtrim(value, F.lit("=")), ""))) >= DISTINCT)


def _runs(items: Column) -> Column:
    """An array that isn't empty as an array of runs of about the root of its size: folds that append stay short."""

    def sliced(every: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(every))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / wide).cast("int")), lambda k: F.slice(every, k * wide + 1, wide))

    # Bound once as a variable: an expression in a function of elements is evaluated anew for each.
    return F.transform(F.array(items), sliced)[0]


def spans(text: Column, kind: str, pattern: str, group: int, least: int, test: str | None = None) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's matches, offsets in code points, end exclusive.

    Runs of pieces are folded by themselves, with offsets from the run's begin, then the runs: time grows with the power 1.5 of the matches.
    """
    shape = "array<struct<start:int,kind:string,end:int,value:string>>"
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        hit = piece["hit"]
        start = acc["at"] + piece["gap"]
        end = start + F.coalesce(F.length(hit), F.lit(0))
        value = F.regexp_extract(hit, pattern, group) if group else hit
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def shift(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    runs = F.transform(_runs(pieces), lambda run: F.aggregate(run, zero, add))
    found = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out")), shift, lambda acc: F.flatten(acc["out"]))
    some = text.rlike(test or pattern) & (F.size(hits) > 0)
    return F.when(some, found).otherwise(F.array().cast(shape))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """row, id, owner, repo, base (spans of the listed kinds) and more (further candidates) of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*(spans(text, *k) for k in KINDS))
    out = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        base.alias("base"),
        spans(text, "token", TOKEN, 0, 20, r"[A-Za-z0-9+/_-]{20}").alias("token"),
    )
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])) & looks_live(t["value"]))
    return out.withColumn("more", free).drop("token")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owners and repos: over how many distinct owners and repositories each value is spread."""
    each = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("hash", "owner").agg(F.count("repo").alias("repos"))
    return each.groupBy("hash").agg(F.count("owner").alias("owners"), F.sum("repos").alias("repos"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, widely: int = WIDELY, copied: int = COPIED) -> DataFrame:
    """id, base and all: arrays of (start, kind, end, live), by start and then kind, of every row."""
    scanned = cut(scan(df, id_col, text_col, owner_col, repo_col))
    each = scanned.select("row", "owner", "repo", F.explode(F.concat("base", "more")).alias("s"))
    each = each.select("row", "owner", "repo", "s.start", "s.kind", "s.end", F.sha2(F.encode("s.value", "UTF-8"), 256).alias("hash"))
    spread = ownership(each)
    copies = cut(spread.where((F.col("owners") >= widely) | (F.col("repos") >= copied)).select("hash", F.lit(True).alias("copied")))
    rank = F.array_position(F.array(*(F.lit(k) for k in ORDER)), F.col("kind")).cast("int")
    live = F.col("copied").isNull()
    told = lookup(each, copies, "hash", "left").select("row", "kind", F.struct("start", rank.alias("rank"), "kind", "end", live.alias("live")).alias("span"))
    told = told.where("kind <> 'token' or span.live").groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("all"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,live:boolean>>")
    out = scanned.select("row", "id").join(told, "row", "left").withColumn("all", F.coalesce("all", empty))
    return out.select(F.col("id").alias(id_col), F.filter("all", lambda s: s["kind"] != "token").alias("base"), "all")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with the spans (by start) replaced; overlapping ones go as one. Each run of spans is cut out of its own stretch of the text."""

    def cut_run(acc: Column, run: Column) -> Column:
        upto = F.greatest(acc["at"], F.array_max(F.transform(run, lambda s: s["end"])))

        def replaced(stretch: Column) -> Column:
            return F.aggregate(
                run,
                F.struct(acc["at"].alias("at"), F.lit("").alias("out")),
                lambda done, s: F.struct(
                    F.greatest(done["at"], s["end"]).alias("at"),
                    F.when(s["start"] < done["at"], done["out"]).otherwise(F.concat(done["out"], F.substring(stretch, done["at"] - acc["at"] + 1, s["start"] - done["at"]), F.lit(mark))).alias("out"),
                ),
                lambda done: done["out"],
            )

        return F.struct(upto.alias("at"), F.concat(acc["out"], F.transform(F.array(F.substring(text, acc["at"] + 1, upto - acc["at"])), replaced)).alias("out"))

    cutter = F.aggregate(
        _runs(found),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        cut_run,
        lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.lit((1 << 31) - 1)))), ""),
    )
    return F.when(F.size(found) > 0, cutter).otherwise(text)
