"""Signature induction over multisets, as set-based DataFrame operators.

Input: occurrences (owner, page, element), one row per occurrence. Per owner the pages are the
(at most X) selected observations. Definitions (per owner):

  c[e][p]   multiplicity of element e on page p;   spread(e) = pages with c > 0
  classes   DX: spread > BB,  NX: 2 <= spread <= BB,  UN: spread = 1
  onlyNX    pages without any UN element
  groups    pages with the same DX multiset {(e, c[e][p]) : e in DX}; n0 = number of groups
  gate      n0 > AA -> the owner yields nothing
  eliminate group g is dropped iff some set S of NX lines gives
              B(S) = #distinct (group(p), c[e][p] for e in S) over all pages <= AA, and
              R(S) = pages of g with c[e][p] = 0 for all e in S, with
              R = {}  or  (R and onlyNX disjoint and |R| + B - 1 <= AA)
  result    surviving groups -> signature = DX multiset expanded, pages = the group

Elimination is evaluated level-wise. A state is (partition, rest) of an (owner, group): pages are
bits of a long, the partition is the sorted array of its block masks, and the rest is a mask. Each
level refines the states by the owner's NX lines (equal-multiplicity classes as masks) that touch
the rest. A useful line either empties the rest or splits it, raising B by at least one, so AA
levels suffice. States are deduplicated on (partition, rest), which bounds them, like the lines, by
a constant that depends only on X, AA and BB. All levels are one expression over a row per
(owner, group); building the plan runs no job.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesig.params import MAX_PAGES, MAX_SIGNATURES, SPREAD_LIMIT
from pagesig.session import reuse


def sg_lines(occ: DataFrame) -> DataFrame:
    """(owner, element, page, cnt): the occurrence pattern of every element."""
    return occ.groupBy("owner", "element", "page").agg(F.count(F.lit(1)).cast("int").alias("cnt"))


def _page_index(lines: DataFrame) -> DataFrame:
    pages = lines.select("owner", "page").distinct()
    w = Window.partitionBy("owner").orderBy("page")
    return (pages.withColumn("pidx", (F.row_number().over(w) - 1).cast("int"))
            .withColumn("x", F.count(F.lit(1)).over(Window.partitionBy("owner")).cast("int"))
            .withColumn("x", F.when(F.col("x") <= MAX_PAGES, F.col("x")).otherwise(F.raise_error(F.lit(
                f"pages are bits of a long: at most {MAX_PAGES} per owner, select the last k first")).cast("int"))))


def sg_shapes(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(owner, element, spread, entries, counts): counts[p] = multiplicity on page index p."""
    rows = lines.join(pages, ["owner", "page"])
    shapes = rows.groupBy("owner", "element").agg(
        F.collect_list(F.struct("pidx", "cnt")).alias("entries"),
        F.max("x").alias("x"))
    m = F.map_from_entries("entries")
    counts = F.transform(F.sequence(F.lit(0), F.col("x") - 1),
                         lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)))
    return shapes.select("owner", "element", F.size("entries").alias("spread"), "entries",
                         counts.alias("counts"))


def sg_classes(shapes: DataFrame, bb: int = SPREAD_LIMIT) -> DataFrame:
    cls = (F.when(F.col("spread") > bb, "DX").when(F.col("spread") >= 2, "NX").otherwise("UN"))
    return shapes.withColumn("cls", cls)


def sg_page_profiles(classed: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: DX multiset (sorted (element, cnt) array, empty if none) and the onlyNX flag."""
    rows = classed.select("owner", "element", "cls", F.explode("entries").alias("e")) \
        .select("owner", "element", "cls", F.col("e.pidx").alias("pidx"), F.col("e.cnt").alias("cnt"))
    prof = rows.groupBy("owner", "pidx").agg(
        F.array_sort(F.collect_list(F.when(F.col("cls") == "DX", F.struct("element", "cnt")))).alias("profile"),
        (~F.bool_or(F.col("cls") == "UN")).alias("only_nx"))
    return pages.join(prof, ["owner", "pidx"])


def sg_dx_groups(profiles: DataFrame) -> DataFrame:
    """Pages with equal DX multiset form a group; gid = smallest page index of the group."""
    w = Window.partitionBy("owner", "profile")
    return profiles.withColumn("gid", F.min("pidx").over(w))


def sg_candidates(grouped: DataFrame, aa: int = MAX_SIGNATURES) -> tuple[DataFrame, DataFrame]:
    """Owner state arrays and the groups of owners passing the gate n0 <= AA."""
    owners = grouped.groupBy("owner").agg(
        F.sort_array(F.collect_list(F.struct("pidx", "gid", "only_nx"))).alias("pp"))
    owners = owners.select(
        "owner",
        F.transform("pp", lambda s: s["gid"].cast("long")).alias("gkeys"),
        F.transform("pp", lambda s: s["only_nx"]).alias("onlynx"),
    ).withColumn("n0", F.size(F.array_distinct("gkeys")))
    owners = owners.where(F.col("n0") <= aa)
    groups = grouped.groupBy("owner", "gid").agg(
        F.first("profile").alias("profile"),
        F.sort_array(F.collect_list("pidx")).alias("members"),
        F.sort_array(F.collect_list("page")).alias("pages"))
    groups = groups.join(owners.select("owner"), "owner", "left_semi")
    return owners, groups


def _bit(pidx: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), pidx)


def _refine(blocks: Column, classes: Column, zero: Column, aa: int, bb: int) -> Column:
    """Blocks (sorted masks, <= aa) refined by a line's classes (<= bb nonzero-count classes
    plus the zero class): the nonzero pairwise intersections, sorted -- canonical."""
    cls = [F.coalesce(F.get(classes, j), F.lit(0).cast("long")) for j in range(bb)] + [zero]
    pieces = [F.coalesce(F.get(blocks, i), F.lit(0).cast("long")).bitwiseAND(c) for i in range(aa) for c in cls]
    return F.array_remove(F.sort_array(F.array(*pieces)), 0)


def sg_eliminate(groups: DataFrame, owners: DataFrame, shapes: DataFrame,
                 aa: int = MAX_SIGNATURES, bb: int = SPREAD_LIMIT) -> DataFrame:
    """(owner, gid) of the groups that some set of NX lines explains away.

    Pages of an owner are bits of a long (at most 63 pages; the pipeline uses 7). A partition
    is the sorted array of its block masks (at most AA blocks are ever kept), a line is the
    masks of its equal-multiplicity classes; refining is a handful of ANDs, and the test is
    arithmetic on masks. One row per (owner, group) carries the owner's lines and folds all levels
    over its array of states: no join, no exchange and no job per level.

    Lossless pruning: lines with the same classes refine identically (deduplicated, so their
    number is bounded by the pages of an owner, not by its elements); B only grows under
    refinement, so a line that alone already gives more than AA blocks is never part of a valid
    set; a group stops expanding once one of its states passes the test; states are deduplicated on
    (partition, rest)."""
    pages = groups.select("owner", F.explode("members").alias("pidx"))
    allmask = pages.groupBy("owner").agg(F.sum(_bit(F.col("pidx"))).alias("all"))
    gm = groups.select("owner", "gid", F.aggregate("members", F.lit(0).cast("long"),
                                                   lambda acc, p: acc.bitwiseOR(_bit(p))).alias("gmask"))
    own = gm.groupBy("owner").agg(F.sort_array(F.collect_list("gmask")).alias("blocks0"))
    onx = owners.select("owner", F.aggregate(
        F.sequence(F.lit(0), F.size("onlynx") - 1), F.lit(0).cast("long"),
        lambda acc, p: F.when(F.col("onlynx")[p], acc.bitwiseOR(_bit(p))).otherwise(acc)).alias("onlynx"), "n0")
    own = own.join(onx, "owner").join(allmask, "owner")

    ent = shapes.where((F.col("spread") >= 2) & (F.col("spread") <= bb)) \
        .select("owner", "element", F.explode("entries").alias("e"))
    cls = ent.groupBy("owner", "element", F.col("e.cnt").alias("cnt")).agg(F.sum(_bit(F.col("e.pidx"))).alias("m"))
    lines = cls.groupBy("owner", "element").agg(F.sort_array(F.collect_list("m")).alias("classes"), F.sum("m").alias("nz")) \
        .groupBy("owner").agg(F.collect_set(F.struct("classes", "nz")).alias("lines"))
    rows = gm.join(own.join(lines, "owner", "left"), "owner").select(
        "owner", "gid", "gmask", "blocks0", "onlynx", "n0", F.filter(F.transform(
            F.coalesce("lines", F.array().cast("array<struct<classes:array<bigint>,nz:bigint>>")),
            lambda ln: F.struct(ln["classes"].alias("classes"), ln["nz"].alias("nz"),
                                F.col("all").bitwiseAND(F.bitwise_not(ln["nz"])).alias("zero"))),
            lambda ln: F.size(_refine(F.col("blocks0"), ln["classes"], ln["zero"], aa, bb)) <= aa).alias("lines"))

    def passes(state: Column) -> Column:
        rest, b = state["rest"], F.size(state["blocks"])
        return (rest == 0) | ((rest.bitwiseAND(F.col("onlynx")) == 0) & (F.bit_count(rest) + b - 1 <= aa))

    def refined(states: Column) -> Column:
        more = F.flatten(F.transform(states, lambda s: F.transform(
            F.filter("lines", lambda ln: s["rest"].bitwiseAND(ln["nz"]) != 0),
            lambda ln: F.struct(_refine(s["blocks"], ln["classes"], ln["zero"], aa, bb).alias("blocks"),
                                s["rest"].bitwiseAND(F.bitwise_not(ln["nz"])).alias("rest")))))
        return F.array_distinct(F.filter(more, lambda s: F.size(s["blocks"]) <= aa))

    def ends(states: Column) -> Column:
        """Whether a line takes one of the states to one that passes: the last level builds and sorts no
        states. A line that leaves some of the rest raises B, so a cheap test on the rest comes first."""
        def may(s: Column, ln: Column) -> Column:
            left = s["rest"].bitwiseAND(F.bitwise_not(ln["nz"]))
            return (s["rest"].bitwiseAND(ln["nz"]) != 0) & ((left == 0) | (
                (left.bitwiseAND(F.col("onlynx")) == 0) & (F.bit_count(left) + F.size(s["blocks"]) <= aa)))

        def does(s: Column, ln: Column) -> Column:
            left, b = s["rest"].bitwiseAND(F.bitwise_not(ln["nz"])), F.size(_refine(s["blocks"], ln["classes"], ln["zero"], aa, bb))
            return (b <= aa) & ((left == 0) | (F.bit_count(left) + b - 1 <= aa))

        return F.exists(states, lambda s: F.exists(F.filter("lines", lambda ln: may(s, ln)), lambda ln: does(s, ln)))

    rows = rows.withColumn("states", F.array(F.struct(F.col("blocks0").alias("blocks"), F.col("gmask").alias("rest"))))
    rows = rows.withColumn("gone", F.exists("states", passes))
    for level in range(1, aa + 1):
        if level == aa:
            rows = rows.withColumn("gone", F.col("gone") | F.coalesce(F.when(~F.col("gone"), ends(F.col("states"))), F.lit(False)))
            break
        rows = rows.withColumn("states", F.when(~F.col("gone"), refined(F.col("states"))))
        rows = rows.withColumn("gone", F.col("gone") | F.coalesce(F.exists("states", passes), F.lit(False)))
    return rows.where("gone").select("owner", "gid")


def expand_profile(profile: Column) -> Column:
    """DX multiset -> element list repeated by multiplicity, in element order."""
    return F.flatten(F.transform(profile, lambda s: F.array_repeat(s["element"], s["cnt"])))


class InductionParts:
    """The relations of the induction by name, each built when first asked for: a part only runs
    what it needs."""

    def __init__(self, occ: DataFrame, aa: int, bb: int):
        self._occ, self.aa, self.bb = occ, aa, bb

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def occ(self) -> DataFrame:
        # The only shuffle of the induction: every later aggregate, window, join and dedup is
        # keyed by owner (+ more columns) and reuses this partitioning. After the k-page selection
        # an owner is bounded (k pages), so a partition never holds an unbounded group.
        return reuse(self._occ.select("owner", "page", F.col("element").cast("string").alias("element"))
                     .repartition("owner"))

    @cached_property
    def lines(self) -> DataFrame:
        return sg_lines(self.occ)

    @cached_property
    def pages(self) -> DataFrame:
        return reuse(_page_index(self.lines))

    @cached_property
    def shapes(self) -> DataFrame:
        return reuse(sg_classes(sg_shapes(self.lines, self.pages), self.bb))

    @cached_property
    def grouped(self) -> DataFrame:
        return reuse(sg_dx_groups(sg_page_profiles(self.shapes, self.pages)))

    @cached_property
    def _candidates(self) -> tuple[DataFrame, DataFrame]:
        owners, groups = sg_candidates(self.grouped, self.aa)
        return reuse(owners), reuse(groups)

    @property
    def owners(self) -> DataFrame:
        return self._candidates[0]

    @property
    def groups(self) -> DataFrame:
        return self._candidates[1]

    @cached_property
    def eliminated(self) -> DataFrame:
        return sg_eliminate(self.groups, self.owners, self.shapes, self.aa, self.bb)

    @cached_property
    def induced(self) -> DataFrame:
        kept = self.groups.join(self.eliminated, ["owner", "gid"], "left_anti")
        return kept.select("owner", expand_profile(F.col("profile")).alias("signature"), "pages") \
            .where(F.size("signature") > 0)


def induction_parts(occ: DataFrame, aa: int = MAX_SIGNATURES, bb: int = SPREAD_LIMIT) -> InductionParts:
    """All intermediate relations of the induction."""
    return InductionParts(occ, aa, bb)


def sg_induce(occ: DataFrame, aa: int = MAX_SIGNATURES, bb: int = SPREAD_LIMIT) -> DataFrame:
    """(owner, signature array<string>, pages array<page>); empty signatures removed."""
    return induction_parts(occ, aa, bb)["induced"]


def sg_only_nx(grouped: DataFrame) -> DataFrame:
    """Pages holding no element that occurs on that page alone."""
    return grouped.where(F.col("only_nx")).select("owner", "page")


def sg_refine(grouped: DataFrame, shapes: DataFrame, bb: int = SPREAD_LIMIT) -> DataFrame:
    """Refine the DX partition by each NX line: blocks of page indices that share the group and
    the line's multiplicity (an owner has at most MAX_PAGES pages, so blocks are bounded)."""
    nx = shapes.where((F.col("spread") >= 2) & (F.col("spread") <= bb)).select("owner", "element", "counts")
    keyed = grouped.select("owner", "pidx", "gid").join(nx, "owner") \
        .select("owner", "element", "gid", "pidx", F.expr("counts[pidx]").alias("cnt"))
    blocks = keyed.groupBy("owner", "element", "gid", "cnt").agg(F.sort_array(F.collect_list("pidx")).alias("block"))
    return blocks.groupBy("owner", "element").agg(F.sort_array(F.collect_list("block")).alias("blocks"))


def sg_noise(induced: DataFrame, occ: DataFrame) -> DataFrame:
    """Per kept signature: occurrences on its pages minus |signature| * |pages| (noise count).

    Sizes and signatures are paired by (owner, page) key, never by position.
    """
    sizes = occ.groupBy("owner", "page").agg(F.count(F.lit(1)).alias("n"))
    sig = induced.select("owner", "signature", "pages", F.explode("pages").alias("page"))
    return (sig.join(sizes, ["owner", "page"])
            .groupBy("owner", "signature", "pages")
            .agg(F.sum("n").alias("total"))
            .select("owner", "signature", "pages",
                    (F.col("total") - F.size("signature") * F.size("pages")).alias("noise")))
