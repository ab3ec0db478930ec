"""Mixing sources to target weights by pivotal dependent rounding in a distributed reduction tree.

Only DataFrame functions are used. Every document of a source starts with the same copy rate; its fractional copy is a
mass of words between nothing and the whole text. Two documents are paired, and words move at random from one to the
other until one is whole or empty, so that the source's sum stays and each mass keeps its expectation. Blocks of a
few documents are reduced this way to one open document each; these meet in blocks of the next level, up to one open
document for each source, which is taken in part. Equal rows are one entry with a count from the start: as they can't be
told apart, their masses are joined to whole ones and one rest, so that no block grows with the rows of one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.llm.shared import settle, small

WORD = r"[^\x20\x09-\x0D]+"
FAN = 64
#: Equal rows that one task writes out at a time.
SPREAD = 4096


def source_targets(sizes: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, docs, target) of each source.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all sizes; a target stops at
    ``most`` times its source's size and the excess is shared anew by weight. That is one water level: sources are
    sorted by the level at which they are full, and the level is where those that are full and those that are not
    agree. The windows run over one row for each source.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count("*").alias("docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    full = F.col("source_size") * F.lit(most)
    rows = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    every = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rows.rowsBetween(0, Window.unboundedFollowing))
    out = per.withColumn("weight", weight).withColumn("full", full).withColumn("full_at", F.col("full") / F.col("weight"))
    out = out.withColumn("level", level)
    water = F.first(F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True).over(every)
    return out.withColumn("water", water).select("source", "source_size", "docs", F.coalesce(F.least("full", F.col("water") * F.col("weight")), F.col("full")).alias("target"))


def _unit(level: int, seed: int, use: str) -> Column:
    """A number in [0, 1) from the document's hash; another one for each ``use``."""
    return F.pmod(F.xxhash64("tie", F.lit(seed), F.lit(level), F.lit(use)), F.lit(1 << 30)) / F.lit(float(1 << 30))


#: One step of the fold: ``acc.open`` is the open document so far or null, ``x`` the next; m words of s are taken. The coin
#: ``x.u`` is not what the items are sorted by: else early pairs would all take one branch.
STEP = """
aggregate(items, named_struct('done', cast(array() as array<{t}>), 'open', cast(null as {t})), (acc, x) ->
  case when acc.open is null then named_struct('done', acc.done, 'open', x)
  else transform(array(
    case when x.u * (least(acc.open.s - acc.open.m, x.m) + least(acc.open.m, x.s - x.m)) < least(acc.open.m, x.s - x.m)
    then case when acc.open.s - acc.open.m <= x.m
         then named_struct('c', acc.open.s, 'x', x.m - (acc.open.s - acc.open.m))
         else named_struct('c', acc.open.m + x.m, 'x', 0D) end
    else case when acc.open.m <= x.s - x.m
         then named_struct('c', 0D, 'x', x.m + acc.open.m)
         else named_struct('c', acc.open.m - (x.s - x.m), 'x', x.s) end
    end), n -> transform(array(named_struct('c', {c}, 'x', {x})), p ->
      case when n.c > 0 and n.c < acc.open.s then named_struct('done', array_append(acc.done, p.x), 'open', p.c)
           when n.x > 0 and n.x < x.s then named_struct('done', array_append(acc.done, p.c), 'open', p.x)
           else named_struct('done', concat(acc.done, array(p.c, p.x)), 'open', cast(null as {t})) end)[0])[0]
  end)"""


def entries(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", digest: Column | None = None, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 6) -> DataFrame:
    """(doc_id, source, size, digest, n, source_size, target, copies, whole, part): what the mix takes of each n equal rows.

    Rows are equal if their ids, sources and digests (of the text, if none is given) are. Each of them is taken ``copies`` times; ``whole`` of them once
    more, and one more, if ``part`` isn't 0, in part, which is so many words.
    """
    key = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (F.xxhash64(text) if digest is None else digest).alias("digest")]
    rows = settle(docs.select(*key).groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n")))
    targets = settle(source_targets(rows.withColumn("all", F.col("size") * F.col("n")), size="all", weights=weights, share=share, most=most))
    n = targets.agg(F.count("*").alias("n"), F.coalesce(F.max("docs"), F.lit(0)).alias("docs")).first()
    right = small(targets.withColumnRenamed("source", "of"), n["n"])
    rows = rows.join(right, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("long"))
    # of n equal rows, as many are whole as their masses make
    mass = F.col("n") * (F.col("rate") - F.floor("rate"))
    rows = rows.withColumn("full", F.floor(mass).cast("long")).withColumn("m", (mass - F.floor(mass)) * F.col("size")).withColumn("tie", F.xxhash64("doc_id", "size", "digest"))
    own = ["doc_id", "digest", "n", "full"]
    kept = [*own, "source", "size", "source_size", "target", "copies"]
    done = rows.where("m <= 0").select(*kept, F.lit(0.0).alias("m"))
    kind = f"struct<doc_id:{rows.schema['doc_id'].dataType.simpleString()},digest:bigint,n:bigint,full:bigint,tie:bigint,place:double,u:double,m:double,s:double>"
    moved = lambda of, m: "named_struct(" + ", ".join(f"'{c}', {of}.{c}" for c in (*own, "tie", "place", "u")) + f", 'm', cast({m} as double), 's', {of}.s)"
    step = STEP.format(t=kind, c=moved("acc.open", "n.c"), x=moved("x", "n.x"))
    open_rows = rows.where("m > 0").withColumn("blocks", F.ceil(F.col("docs") / FAN))
    most_blocks, level = -(-n["docs"] // FAN), 0
    of_source = ["source", "source_size", "target", "copies", "blocks"]
    while True:
        item = F.struct(*own, "tie", _unit(level, seed, "place").alias("place"), _unit(level, seed, "coin").alias("u"), "m", F.col("s") if level else F.col("size").cast("double").alias("s"))
        block = F.pmod(F.xxhash64("tie", F.lit(seed), F.lit(level), F.lit("block")), F.greatest(F.col("blocks"), F.lit(1)))
        items = open_rows.groupBy(*of_source, block.alias("block")).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)).alias("items"))
        folded = settle(items.select(*of_source, F.expr(step).alias("f")))
        done = done.unionByName(folded.select(*of_source[:4], F.explode("f.done").alias("d")).select(*(f"d.{c}" for c in own), "source", F.col("d.s").cast("long").alias("size"), "source_size", "target", "copies", "d.m"))
        open_rows = folded.where("f.open IS NOT NULL").select("f.open.*", *of_source[:4], F.ceil(F.col("blocks") / FAN).alias("blocks"))
        if most_blocks <= 1:
            break
        most_blocks, level = -(-most_blocks // FAN), level + 1
    done = done.unionByName(open_rows.select(*own, "source", F.col("s").cast("long").alias("size"), "source_size", "target", "copies", F.round("m").alias("m")))
    filled = (F.col("m") > 0) & (F.round("m") >= F.col("size"))
    whole = F.col("full") + F.when(filled, 1).otherwise(0)
    return done.select("doc_id", "source", "size", "digest", "n", "source_size", "target", "copies", whole.alias("whole"), F.when(filled, 0).otherwise(F.round("m")).cast("long").alias("part"))


def written_out(groups: DataFrame) -> DataFrame:
    """``groups`` with a row for each of their n rows, and ``taken`` of it; ``copies`` counts the whole ones.

    Large groups are split into ranges of SPREAD rows first, which are dealt out, so that no task writes one whole.
    """
    ranges = groups.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPREAD).cast("long"))))
    large = ranges.where(F.col("n") > SPREAD)
    large = large.repartition(F.xxhash64("doc_id", "digest", "_from"))
    each = ranges.where(F.col("n") <= SPREAD).unionByName(large).withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + SPREAD, F.col("n")) - 1)))
    more = F.when(F.col("_i") < F.col("whole"), F.col("size")).when(F.col("_i") == F.col("whole"), F.col("part")).otherwise(0)
    copies = F.col("copies") + (F.col("_i") < F.col("whole")).cast("long")
    return each.withColumn("taken", F.col("copies") * F.col("size") + more).withColumn("copies", copies).drop("_from", "_i", "whole", "part", "n", "digest")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 6) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): the words that the mix takes of each document.

    ``taken`` is ``copies`` whole texts, but for one document at most of each source, of which it is a part (``copies``
    then counts the whole ones). A source's words taken are its target rounded; no document exceeds ``most`` times its
    size, for a whole ``most``. Reruns agree: chance comes from hashes of the ids and texts. One row per row, repeated and null
    ids included; null and empty texts have size 0 and none taken; null is a source; no rows give no rows.
    """
    made = entries(docs, doc_id=doc_id, source=source, text=text, weights=weights, share=share, most=most, seed=seed)
    return written_out(made).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Own columns of these names are replaced. Rows are matched by id, source and a digest of all columns, so that rows of
    one id, null included, stay one to one; of equal rows that aren't all taken alike, some get more. Texts are
    shuffled once. Columns may not be maps.
    """
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")))
    digest = F.xxhash64(*docs.columns)
    made = settle(entries(docs, doc_id=doc_id, source=source, text=text, digest=digest, **options).where("copies > 0 OR whole > 0 OR part > 0"))
    several = (made.agg(F.max("n")).first()[0] or 1) > 1
    extra = {c: f"_mix_{c}" for c in made.columns}
    right = made.withColumnsRenamed(extra)
    here = docs.withColumn("_digest", digest)
    same = F.col(doc_id).eqNullSafe(F.col("_mix_doc_id")) & F.col(source).eqNullSafe(F.col("_mix_source")) & (F.col("_digest") == F.col("_mix_digest"))
    # wider than ids, so always shuffled and never sent to every task
    both = here.join(right.hint("merge"), same).drop("_digest")
    groups = both.select(F.struct(*docs.columns).alias("_row"), *(F.col(v).alias(k) for k, v in extra.items()))
    if several:  # one row stands for those that are equal; summed up before the shuffle
        groups = groups.where("n = 1").unionByName(groups.where("n > 1").groupBy("doc_id", "source", "digest").agg(*(F.first(c).alias(c) for c in ("_row", "size", "n", "source_size", "target", "copies", "whole", "part"))))
    out = written_out(groups).where("taken > 0")
    return out.select(*(F.col("_row")[c].alias(c) for c in docs.columns), "size", "source_size", "target", "copies", "taken")
