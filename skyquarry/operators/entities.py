"""Entities: catalogs with validity, attribute filters, bitemporal claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import content_id, empty_matches, matches
from .work import ON, Slices, blocks, digits, spread, written

FOREVER = 1 << 62
#: Parts over which claims about all entities are repeated.
SPREAD = 64


def as_of(dim: DataFrame, t: int, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Versions with start <= t < end; a null end is open."""
    return dim.filter((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


#: Slices of time in which versions of a key are looked up.
SLICES = 64


def join_as_of(facts: DataFrame, dim: DataFrame, keys: list[str], time: str, how: str = "left", span: tuple[int, int] | None = None, slices: int = SLICES) -> DataFrame:
    """Each fact beside the version of its entity at its time; versions (valid_from, valid_to) of an entity don't overlap.

    span: the range of time in which versions change, cut into slices. A version stands once in each slice that it touches
    (all versions of a key together in `slices` more rows than they are), and a fact only meets those of its own slice;
    facts of a hot key are spread by their slices. Times outside the span belong to the first and the last slice.
    """
    dim = dim.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    on, facts_, dim_ = list(keys), facts, dim
    if span:
        lo, step = span[0], max(1, -(-(span[1] - span[0]) // slices))
        of = lambda t: F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.floor((t - lo) / step))).cast("int")
        until = F.when(F.col("valid_to").isNull(), F.lit(slices - 1)).otherwise(of(F.col("valid_to") - 1))
        dim_ = dim.withColumn("slice_", F.explode(F.sequence(of(F.col("valid_from")), until)))
        facts_, on = facts.withColumn("slice_", of(F.col(time))), [*on, "slice_"]
    both = [facts_[k] == dim_[k] for k in on] + [facts_[time] >= dim_["valid_from"], dim_["valid_to"].isNull() | (facts_[time] < dim_["valid_to"])]
    return facts_.join(dim_, both, how).select(*(facts_[c] for c in facts.columns), *(dim_[c] for c in dim.columns if c not in keys))


def attribute_rows(dim: DataFrame, entity: str, attributes: str) -> DataFrame:
    """(key, value, entity), each once."""
    return dim.select(F.explode(attributes).alias("key", "value"), entity).distinct()


def attribute_filter(facts: DataFrame, kv: DataFrame, entity: str, key: str, op: str, values: list[str], residual: str | None = None, covered: list[str] | None = None) -> DataFrame:
    """Facts whose entity's attribute satisfies `op values`, where a missing attribute reads as an empty text.

    If an empty text satisfies it, entities that don't are excluded (anti join); else those that do are kept (semi join).
    residual: the map of attributes that facts carry themselves. It decides for the keys it holds, the catalog for all
    others. covered: the keys that the catalog has; a key that is not among them is looked up in the residual alone.
    """
    of, hold = kv.filter(F.col("key") == key), matches(F.col("value"), op, values)
    own = F.try_element_at(residual, F.lit(key)) if residual else None
    if residual and covered is not None and key not in covered:
        return facts.filter(matches(F.coalesce(own, F.lit("")), op, values))
    empty = empty_matches(op, values)
    found = of.filter(~hold if empty else hold).select(entity).distinct()
    if not residual:
        return facts.join(found, entity, "left_anti" if empty else "left_semi")
    # a left join keeps each fact once, as found has an entity once
    both = facts.join(found.withColumn("found_", F.lit(True)), entity, "left")
    there = F.coalesce(F.map_contains_key(residual, key), F.lit(False))
    by_catalog = F.col("found_").isNull() if empty else F.col("found_").isNotNull()
    return both.filter(F.when(there, matches(F.coalesce(own, F.lit("")), op, values)).otherwise(by_catalog)).select(*facts.columns)


def resource_ids(df: DataFrame, attributes: str, covered: list[str], prefix: str = "k8s.pod.label.") -> DataFrame:
    """df with resource_id, a hash of the covered attributes that aren't empty, and residual, the other attributes."""
    is_covered = lambda k, v: k.isin(covered) | k.startswith(prefix)
    return df.withColumn("resource_id", content_id(F.map_filter(attributes, is_covered))).withColumn("residual", F.map_filter(attributes, lambda k, v: ~is_covered(k, v)))


def merge_versions(rows: DataFrame, key: list[str]) -> DataFrame:
    """Reports of a version as one: earliest beginning, the last report's end, uncertain if any report is."""
    return rows.groupBy(*key).agg(F.min("valid_from").alias("valid_from"), F.max_by("closed_at", F.struct("observed", "closed_at")).alias("closed_at"), F.max("uncertain").alias("uncertain"), F.min("attrs").alias("attrs"))


def with_announced(controller: DataFrame, announced: DataFrame, key: str, tail: int) -> DataFrame:
    """Entities of the controller, and those only announced, uncertain and valid until `tail` after they were last seen."""
    only = announced.join(controller.select(key).distinct(), key, "left_anti")
    return controller.select(key, "valid_from", "valid_to", F.lit(False).alias("uncertain")).unionByName(only.select(key, F.col("first_seen").alias("valid_from"), (F.col("last_seen") + tail).alias("valid_to"), F.lit(True).alias("uncertain")))


def lifetimes_in_buckets(dim: DataFrame, step: int, lo: int, hi: int) -> DataFrame:
    """A row for each step in [lo, hi) that an entity's validity overlaps."""
    first = F.greatest(F.col("valid_from"), F.lit(lo))
    last = F.least(F.coalesce("valid_to", F.lit(hi)), F.lit(hi)) - 1
    rows = dim.filter(first <= last)
    return rows.withColumn("bucket", F.explode(F.sequence(first - F.pmod(first, F.lit(step)), last - F.pmod(last, F.lit(step)), F.lit(step))))


# Bitemporal claims: entity, kind (assert, retract, unknown, pseudonymise), source (controller, ..., announce), seq, version,
# valid_from, valid_to, system_from. entity null stands for all entities.


def precedence(trust: int) -> Column:
    """Order among authorities: effective time (a controller's counts `trust` later), controllers first, sequence."""
    controller = F.col("source") == "controller"
    return F.struct((F.col("system_from") + F.when(controller, trust).otherwise(0)).alias("e"), controller.alias("c"), F.col("seq").alias("s"))


def _tops(trust: int) -> list[Column]:
    """Aggregates over claims: a, the top authority, and n, the top announcement. Both are maxima, so parts combine."""
    announced = F.col("source") == "announce"
    a = F.max(F.when(~announced, F.struct(precedence(trust).alias("p"), F.col("kind"), F.col("version")))).alias("a")
    n = F.max(F.when(announced & (F.col("kind") == "assert"), F.struct("system_from", "seq", "version"))).alias("n")
    return [a, n]


def _answers(top: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., a, n) -> status, version, uncertain.

    The top authority decides: assert gives its version, retract none, unknown the top announcement, uncertain, if there
    is one. Without authority the top announcement is certain.
    """
    kind, said = F.col("a.kind"), F.col("n").isNotNull()
    status = F.when(kind == "assert", "asserted").when(kind == "retract", "retracted").when(said, "announced").when(kind == "unknown", "unknown").otherwise("absent")
    version = F.when(kind == "assert", F.col("a.version")).when(kind == "retract", F.lit(None)).otherwise(F.col("n.version"))
    return top.select(*keys, status.alias("status"), version.alias("version"), F.coalesce((kind == "unknown") & said, F.lit(False)).alias("uncertain"))


def spread_all(claims: DataFrame) -> DataFrame:
    """Claims about all entities, repeated for each that is named somewhere."""
    one, all_ = claims.filter("entity is not null"), claims.filter("entity is null")
    names = one.select("entity").distinct()
    # dealt out over SPREAD parts: each holds its names and all of the claims about all
    part = F.pmod(F.xxhash64("entity"), F.lit(SPREAD)).alias("part_")
    every = all_.drop("entity").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return one.unionByName(names.select("entity", part).join(every, "part_").select(*one.columns))


def point(claims: DataFrame, vt: int, st: int, trust: int) -> DataFrame:
    """What was known at system time st about each entity at valid time vt."""
    here = claims.filter((F.col("system_from") <= st) & (F.col("valid_from") <= vt) & (F.coalesce("valid_to", F.lit(FOREVER)) > vt))
    return _answers(here.filter("kind <> 'pseudonymise'").groupBy("entity").agg(*_tops(trust)), ["entity"])


def intervals(claims: DataFrame, st: int, trust: int) -> DataFrame:
    """(entity, lo, hi, status, version, uncertain): disjoint intervals of valid time with what was known at st.

    Boundaries of an entity's claims cut its time into numbered slices. A claim covers a run of slices, which is a union of
    at most two blocks of each size 1, 2, 4, ...; the top claims of a block are found once, and a slice looks at the blocks
    that it lies in. So n claims of an entity cost n log n, not n slices each, and no task holds an entity as a whole but
    to number its slices. Neighbours with equal answers are merged.
    """
    known = claims.filter(F.col("system_from") <= st).withColumn("valid_to", F.coalesce("valid_to", F.lit(FOREVER))).filter("valid_from < valid_to")
    edges = known.select("entity", F.explode(F.array("valid_from", "valid_to")).alias("lo")).distinct()
    w = Window.partitionBy("entity").orderBy("lo")
    n = F.count("*").over(Window.partitionBy("entity"))
    edges = edges.select("entity", "lo", F.lead("lo").over(w).alias("hi"), (F.row_number().over(w) - 1).cast("long").alias("i"), digits(n).alias("most"))
    at = lambda time, name: edges.select("entity", F.col("lo").alias(time), F.col("i").alias(name))
    rows = known.filter("kind <> 'pseudonymise'").join(at("valid_from", "b"), ["entity", "valid_from"]).join(at("valid_to", "e"), ["entity", "valid_to"])
    covered = rows.withColumn("block", F.explode(blocks(F.col("b"), F.col("e")))).groupBy("entity", "block.level", "block.i").agg(*_tops(trust))
    slices = edges.filter("hi is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("most"))))
    slices = slices.select("entity", "lo", "hi", "level", F.call_function("shiftright", "i", "level").alias("i"))
    top = slices.join(covered, ["entity", "level", "i"]).groupBy("entity", "lo", "hi").agg(F.max("a").alias("a"), F.max("n").alias("n"))
    return merge_adjacent(_answers(top, ["entity", "lo", "hi"]), ["entity"], ["status", "version", "uncertain"])


def merge_adjacent(rows: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Intervals [lo, hi) that touch and agree become one."""
    w = Window.partitionBy(*keys).orderBy("lo")
    agree = F.col("lo") == F.lag("hi").over(w)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = rows.withColumn("new_", F.when(F.coalesce(agree, F.lit(False)), 0).otherwise(1)).withColumn("run_", F.sum("new_").over(w))
    return rows.groupBy(*keys, "run_", *same).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run_")


def redacted(resolved: DataFrame, claims: DataFrame) -> DataFrame:
    """The first pseudonym of an entity replaces the version of asserted answers, at whatever basis."""
    names = claims.filter("kind = 'pseudonymise'").groupBy("entity").agg(F.min_by("version", F.struct("system_from", "seq")).alias("pseudonym"))
    out = resolved.join(names, "entity", "left")
    return out.withColumn("version", F.when((F.col("status") == "asserted") & F.col("pseudonym").isNotNull(), F.col("pseudonym")).otherwise(F.col("version"))).drop("pseudonym")


def claims_from_lanes(records: DataFrame) -> DataFrame:
    """Records of entity lanes -> claims of the controller, as a cluster's objects tell them in order.

    records: lane, n (the object's number in its lane), o (place in the object), kind, entity, version, t, until.
    delta: the version holds from t on, or, if it is null, the entity is gone from t on. sync: all that holds at t, a record
    for each entity and one without (an empty sync has only that); what was alive before and is not in it is gone from t
    on. gap: [t, until) was not watched; restart: from t until the next sync (for good if there is none). What the records
    up to a gap assert at its beginning is unknown in it; what was gone already, or is not there yet, is not.

    Claims of a lane are ordered by seq: a sync's retractions, then records as they were written; the later one counts.
    An entity's records are written in the order of their times, so at a gap one rule of it holds at most, and claims of gaps,
    which can be as many as gaps times entities, leave their join as they are: only gaps that are told twice are made one.
    Lanes are dealt out, and entities within a lane; only a lane's list of objects is in one task. Gaps meet the rules of
    their lane by slices of object numbers and of time, so a gap is compared with those that stand near it.
    """
    if "until" not in records.columns:
        records = records.withColumn("until", F.lit(None).cast("long"))
    if "o" not in records.columns:
        records = records.withColumn("o", F.lit(0).cast("long"))
    seq = lambda n, o: F.shiftleft(F.col(n).cast("long"), 24) + o
    own = records.filter("kind in ('delta', 'sync') and entity is not null")
    syncs = records.filter("kind = 'sync'").groupBy("lane", "n").agg(F.max("t").alias("sync_t"))
    # for each object the next sync after it
    objects = records.select("lane", "n").distinct().join(syncs, ["lane", "n"], "left")
    later = Window.partitionBy("lane").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    a_sync = F.when(F.col("sync_t").isNotNull(), F.struct(F.col("n").alias("n"), F.col("sync_t").alias("t")))
    objects = objects.select("lane", "n", F.min(a_sync).over(later).alias("next_sync"))
    w = Window.partitionBy("lane", "entity").orderBy("n", "o", "t")
    events = own.select("lane", "entity", "n", "o", "version", "t", F.lead("n").over(w).alias("n2"), F.lead("o").over(w).alias("o2"), F.lead("t").over(w).alias("t2"))
    events = events.join(objects, ["lane", "n"])
    lapsed = F.col("version").isNotNull() & F.col("next_sync").isNotNull() & (F.col("n2").isNull() | (F.col("next_sync.n") < F.col("n2")))
    events = events.withColumn("lapsed", F.coalesce(lapsed, F.lit(False)))
    claim = lambda kind, at, frm, to, version: [F.col("lane"), F.col("entity"), kind.alias("kind"), F.lit("controller").alias("source"), at.alias("seq"), version.alias("version"), frm.alias("valid_from"), to.alias("valid_to")]
    none, no_version = F.lit(None).cast("long"), F.lit(None).cast("string")
    said = events.select(*claim(F.when(F.col("version").isNull(), "retract").otherwise("assert"), seq("n", F.col("o") + 1), F.col("t"), none, F.col("version")), F.col("t").alias("system_from"))
    gone = events.filter("lapsed").select(*claim(F.lit("retract"), seq("next_sync.n", F.lit(0)), F.col("next_sync.t"), none, no_version), F.col("next_sync.t").alias("system_from"))
    # an event rules until the entity's next one, its own or the sync that lacks it
    by_sync = F.struct(F.col("next_sync.n").alias("n"), F.lit(-1).cast("long").alias("o"), F.col("next_sync.t").alias("t"))
    after = F.when(F.col("lapsed"), by_sync).otherwise(F.struct(F.col("n2").alias("n"), F.col("o2").alias("o"), F.col("t2").alias("t")))
    rules = events.filter("version is not null").select("lane", "entity", F.col("n").alias("from_n"), F.col("o").alias("from_o"), F.col("t").alias("from_t"), after["n"].alias("to_n"), after["o"].alias("to_o"), after["t"].alias("to_t"))
    gaps = records.filter("kind in ('gap', 'restart')").select("lane", "n", "o", "kind", "t", "until").join(objects, ["lane", "n"])
    until = F.when(F.col("kind") == "gap", F.col("until")).otherwise(F.col("next_sync.t"))
    gaps = gaps.select("lane", "n", "o", "t", until.alias("until")).filter(F.col("until").isNull() | (F.col("until") > F.col("t"))).distinct()
    # a rule is over at a gap if what ended it was written before the gap, and for a time at or before it
    told = lambda of: (F.col(f"{of}_n") < F.col("n")) | ((F.col(f"{of}_n") == F.col("n")) & (F.col(f"{of}_o") < F.col("o")))
    ended = F.coalesce(told("to"), F.lit(False))
    started = told("from") & (F.col("from_t") <= F.col("t"))
    gaps, rules = written(gaps, "lane-gaps"), written(rules, "lane-rules")
    order, time = Slices.of(gaps, "n"), Slices.of(gaps, "t")
    rules = spread(rules)  # a small file of rules may hold for many gaps
    # gaps written while a rule stood, and gaps written later for a time at which it still did
    standing = order.points(gaps, F.col("n")).join(order.intervals(rules, F.col("from_n"), F.col("to_n")), ["lane", *ON]).filter(started & ~ended)
    again = time.points(gaps, F.col("t")).join(time.intervals(rules.filter("to_t > from_t"), F.col("from_t"), F.col("to_t")), ["lane", *ON]).filter(started & ended & (F.col("to_t") > F.col("t")))
    lost = standing.unionByName(again)
    lost = lost.select(*claim(F.lit("unknown"), seq("n", F.col("o") + 1), F.col("t"), F.col("until"), no_version), F.coalesce("until", "t").alias("system_from"))
    return said.unionByName(gone).unionByName(lost)


def lookup_chain(facts: DataFrame, steps: list[tuple[DataFrame, str, str]], default: str = "") -> DataFrame:
    """Follow keys through dimensions: each step is (dimension, key, column it gives); what isn't found reads as default.

    A dimension's rows are folded to one for each key, so facts keep their number; Spark broadcasts those that are small.
    """
    out = facts
    for dim, key, gives in steps:
        one = dim.groupBy(key).agg(F.min(gives).alias(gives))
        out = out.join(one, key, "left")
    columns = [g for _, _, g in steps]
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(default)) for c in columns})


def in_gaps(versions: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """versions with uncertain: does one begin or close inside a gap [lo, hi) of its cluster?

    Gaps of a cluster are merged, so that a time lies in one at most, and meet times by slices, not by the cluster alone.
    """
    merged = written(merge_overlapping(gaps, [key]), "merged-gaps")
    ends = versions.select(key, "version", F.explode(F.array("valid_from", "closed_at")).alias("t")).filter("t is not null")
    time = Slices.of(merged.select(F.explode(F.array("lo", "hi")).alias("x")), "x")
    near = time.points(ends, F.col("t")).join(time.intervals(merged, F.col("lo"), F.col("hi")), [key, *ON])
    hit = near.filter("t >= lo and t < hi").select(key, "version").distinct().withColumn("hit_", F.lit(True))
    return versions.join(hit, [key, "version"], "left").withColumn("uncertain", F.coalesce("hit_", F.lit(False))).drop("hit_")


def merge_overlapping(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Union of intervals [lo, hi) by key, as disjoint ones."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new_", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)).withColumn("run_", F.sum("new_").over(w))
    return rows.groupBy(*keys, "run_").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run_")


def claims_from_announcements(seen: DataFrame, tail: int) -> DataFrame:
    """(entity, version, t) sightings -> claims that the version holds from its first sighting until `tail` after each.

    A sighting only adds a claim if it reaches beyond what the ones before it said.
    """
    w = Window.partitionBy("entity", "version").orderBy("t")
    first, before = F.min("t").over(w), F.max(F.col("t") + 1 + tail).over(w.rowsBetween(Window.unboundedPreceding, -1))
    until = F.col("t") + 1 + tail
    rows = seen.withColumns({"valid_from": first, "old_": before}).filter(F.col("old_").isNull() | (until > F.col("old_")))
    return rows.select("entity", F.lit("assert").alias("kind"), F.lit("announce").alias("source"), F.row_number().over(Window.partitionBy("entity").orderBy("t", "version")).cast("long").alias("seq"), "version", "valid_from", until.alias("valid_to"), F.col("t").alias("system_from"))


def visible_persons(persons: DataFrame, resources: DataFrame, viewer: str, namespaces: list[str]) -> DataFrame:
    """Persons that a viewer may resolve: itself, and those announced in a namespace that the viewer holds."""
    there = resources.filter(F.col("namespace").isin(namespaces)).select("person").distinct()
    return persons.filter(F.col("person") == viewer).unionByName(persons.filter(F.col("person") != viewer).join(there, "person", "left_semi"))
