"""Labels bound to definitions: a cascade of joins over the scopes that can hold a name.

Every distinct (module, name) is looked up once, however often it is used; a re-export is followed a step at a time, and
only names that are still open take part in the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.session import cut
from graphloom.sources.python_source import BUILTINS, STANDARD

REEXPORTS = 6
SELF = ("self", "cls", "this")
_ANNOTATION = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"


def _parts(c: Column) -> Column:
    return F.filter(F.split(F.replace(c, F.lit("(...)"), F.lit("")), r"\."), lambda x: x != "")


def _rest(parts: Column, start: int = 2) -> Column:
    return F.slice(parts, start, F.greatest(F.size(parts) - (start - 1), F.lit(0)))


def _dotted(*parts) -> Column:
    return F.array_join(F.filter(F.concat(*[p if p is not None else F.array() for p in parts]), lambda x: x != ""), ".")


def module_of(nodes: DataFrame, contains: DataFrame, most: int = 64) -> DataFrame:
    """node and module: the nearest module up the ``contains(child, parent)`` chain, within ``most`` steps.

    Pointer jumping: the reach doubles each round and rounds end once no pointer moves. Modules point at themselves.
    """
    modules = nodes.filter("node_type = 'module'").select(F.col("id").alias("node"), F.col("id").alias("module"), F.lit(True).alias("done"))
    one = contains.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("module"))
    found = cut(modules.unionByName(one.join(modules, "node", "left_anti").withColumn("done", F.lit(False))))
    step = 1
    while step < most and not found.filter("NOT done").isEmpty():
        ahead = found.toDF("via", "module", "done")
        jumped = found.filter("NOT done").select("node", F.col("module").alias("via")).join(ahead, "via", "left")
        found = cut(found.filter("done").unionByName(jumped.select("node", "module", F.coalesce("done", F.lit(True)).alias("done"))))
        step *= 2
    return found.filter("done AND module IS NOT NULL").select("node", "module")


class Scopes:
    """Tables of a set of records: nodes, what is named how, and what imports bind."""

    def __init__(self, records: DataFrame):
        nodes = records.filter("kind = 'node'").groupBy("id").agg(F.first("type").alias("node_type"), F.first("args").alias("args"), F.first("annotations").alias("annotations"))
        self.nodes = cut(nodes.withColumn("dotted", C.body(F.col("id"))))
        contains = records.filter("type = 'contains'").select(F.col("dst").alias("child"), F.col("src").alias("parent"))
        self.module_of = module_of(self.nodes, contains)
        self.named = self.nodes.groupBy(F.col("dotted").alias("q")).agg(F.min_by("id", F.struct(F.col("node_type") != "module", "id")).alias("hit"), F.min_by("node_type", F.struct(F.col("node_type") != "module", "id")).alias("hit_type"))
        self.modules = self.nodes.filter("node_type = 'module'").select(F.col("id").alias("module_id"), F.col("dotted").alias("module_dotted"))
        imports = records.filter("type = 'imports' AND head IS NOT NULL")
        self.bindings = imports.groupBy(F.col("src").alias("at_module"), F.col("head").alias("bound")).agg(F.max_by(F.struct("at", "held", "bare"), F.col("line")).alias("b")).select("at_module", "bound", "b.at", "b.held", "b.bare")
        classes = self.nodes.filter("node_type = 'class'").select(F.col("id").alias("parent"), F.col("dotted").alias("container_dotted"))
        self.containers = contains.join(classes, "parent").select(F.col("child").alias("node"), F.col("parent").alias("container"), "container_dotted").dropDuplicates(["node"])

    def lookup(self, asked: DataFrame) -> DataFrame:
        """hit, hit_type, how, qualified and shadowed for each distinct ``asked(module_id, name)``.

        First the module's own definition, then its imports, followed through the imports of the modules they name.
        """
        named, wide = self.named, asked.distinct().join(self.modules, "module_id")
        wide = wide.withColumn("parts", _parts(F.col("name"))).filter(F.size("parts") > 0)
        wide = wide.withColumn("q", F.concat_ws(".", "module_dotted", _dotted(F.col("parts")))).join(named, "q", "left")
        heads = named.select(F.col("q").alias("own"), F.lit(True).alias("own_head"))
        wide = cut(wide.withColumn("own", F.concat(F.col("module_dotted"), F.lit("."), F.col("parts")[0])).join(heads, "own", "left"))
        keys = ["module_id", "name"]
        local = wide.select(*keys, "hit", "hit_type", F.when(F.col("hit").isNotNull(), "local").alias("how"), F.when(F.col("hit").isNull() & F.col("own_head") & (F.size("parts") > 1), F.col("q")).alias("shadow_q"))
        state = wide.filter("hit IS NULL").select(*keys, F.col("module_id").alias("at_module"), F.col("parts")[0].alias("bound"), _rest(F.col("parts")).alias("rest"), F.lit(None).cast("string").alias("kept"), F.lit(False).alias("frozen"))
        done = None
        for depth in range(REEXPORTS + 1):
            met = state.join(self.bindings, ["at_module", "bound"], "left")
            plain = F.col("held").isNull()
            now = F.when(plain, F.when(F.col("bare"), _dotted(F.array("bound"), F.col("rest"))).otherwise(_dotted(F.array("at"), F.col("rest")))).otherwise(_dotted(F.array("at"), F.array("held"), F.col("rest")))
            met = met.withColumn("q", F.when(F.col("at").isNotNull(), now)).join(named, "q", "left")
            met = met.withColumn("kept", F.when(F.col("hit").isNotNull() | ~F.col("frozen"), F.coalesce("q", "kept")).otherwise(F.col("kept")))
            met = cut(met)
            how = F.when(F.col("hit").isNotNull(), "import" if depth == 0 else "reexport").otherwise("import")
            open_ = met.filter("hit IS NULL AND at IS NOT NULL")
            ended = met.filter("hit IS NOT NULL OR at IS NULL")
            if depth == REEXPORTS or open_.isEmpty():
                ended = met
            ended = ended.select(*keys, F.col("hit").alias("far"), F.col("hit_type").alias("far_type"), how.alias("far_how"), "kept")
            done = ended if done is None else done.unionByName(ended)
            if depth == REEXPORTS or open_.isEmpty():
                break
            goes = open_.select(*keys, "kept", "frozen", "at", "held", "rest", "q", F.col("held").isNull().alias("plain"))
            direct = goes.filter("NOT plain").join(self.modules.toDF("at_module", "at"), "at", "left").select(*keys, "at_module", F.col("held").alias("bound"), "rest", "kept", "frozen")
            # a plain import: the longest module that the qualified name starts with binds its next segment
            cuts = goes.filter("plain").withColumn("p", F.split("q", r"\."))
            each = cuts.select(*keys, "kept", "p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1)))).alias("n")).withColumn("prefix", F.array_join(F.slice("p", F.lit(1), F.col("n")), "."))
            longest = each.join(self.modules.toDF("at_module", "prefix"), "prefix", "left").groupBy(*keys).agg(F.max_by(F.struct("at_module", "n", "p", "kept"), F.when(F.col("at_module").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("b"))
            through = longest.select(*keys, "b.at_module", F.get(F.col("b.p"), F.col("b.n")).alias("bound"), F.slice(F.col("b.p"), F.col("b.n") + 2, F.greatest(F.size("b.p") - F.col("b.n") - 1, F.lit(0))).alias("rest"), "b.kept", F.lit(True).alias("frozen"))
            state = direct.unionByName(through)
        if done is None:
            return local
        out = local.join(done, keys, "left")
        return cut(out.select(*keys, F.coalesce("hit", "far").alias("hit"), F.coalesce("hit_type", "far_type").alias("hit_type"), F.coalesce("how", F.when(F.col("kept").isNotNull(), F.col("far_how"))).alias("how"), "kept", "shadow_q"))


def resolve(records: DataFrame, standard: tuple[str, ...] = STANDARD) -> DataFrame:
    """src, dst, edge_type, line, label, via, why and qualified of every edge that has an end left as text.

    The scopes, in order: self / cls / this (the container), super (its first resolved base), a parameter (the class its
    annotation names), the module's own definitions, its imports with re-exports, builtins. ``via`` names the scope; where
    nothing binds, ``why`` says what the label is: unresolved, builtin, unbound-attribute, unbound-super, stdlib, missing
    (a minted scheme without that node) or unminted. Bases are resolved first, since super needs them.

    The records are read many times, so they are kept first: files are parsed once.
    """
    records = cut(records)
    scopes = Scopes(records)
    texts = records.filter("kind = 'edge' AND (dst IS NULL AND dst_repr IS NOT NULL OR src IS NULL AND src_repr IS NOT NULL)")
    side = F.when(F.col("dst").isNull() & F.col("dst_repr").isNotNull(), "dst").otherwise("src")
    edges = texts.select("src", "dst", F.col("type").alias("edge_type"), "line", side.alias("side"), F.when(side == "dst", F.col("dst_repr")).otherwise(F.col("src_repr")).alias("label"))
    edges = edges.withColumn("from", F.coalesce("src", "dst"))
    inherits = _bind(edges.filter("edge_type = 'inherits'"), scopes, standard, None)
    bases = cut(inherits.filter("dst IS NOT NULL").groupBy(F.col("src").alias("container")).agg(F.min_by("dst", F.struct("line", "label")).alias("base")))
    return inherits.unionByName(_bind(edges.filter("edge_type <> 'inherits'"), scopes, standard, bases))


def _bind(edges: DataFrame, scopes: Scopes, standard: tuple[str, ...], bases: DataFrame | None) -> DataFrame:
    facts = scopes.nodes.select(F.col("id").alias("from"), "args", "annotations")
    asked = edges.select("from", "side", "label").distinct()
    asked = asked.join(facts, "from", "left").join(scopes.module_of.toDF("from", "module_id"), "from", "left").join(scopes.containers.withColumnRenamed("node", "from"), "from", "left")
    parts = _parts(F.col("label"))
    head = F.get(parts, F.lit(0))
    rule = F.when((F.size(parts) == 0) | F.col("module_id").isNull(), "none").when(head.isin(*SELF), "self").when(head == "super", "super").when((F.col("side") == "dst") & F.coalesce(F.array_contains("args", head), F.lit(False)), "param").otherwise("scope")
    asked = cut(asked.withColumn("rule", rule).withColumn("size", F.size(parts)).withColumn("head", head).withColumn("attr", F.when(F.size(parts) == 2, F.get(parts, F.lit(1)))).withColumn("annotation", F.when(F.col("rule") == "param", F.element_at("annotations", head))))
    scoped = asked.filter("rule = 'scope'").select("module_id", F.col("label").alias("name"))
    annotated = asked.filter(F.col("annotation").rlike(_ANNOTATION)).select("module_id", F.col("annotation").alias("name"))
    found = scopes.lookup(scoped.unionByName(annotated))
    dotted = scopes.nodes.select(F.col("id"), F.col("dotted"))
    owner = asked.filter("rule IN ('self', 'super', 'param')")
    if bases is not None:
        owner = owner.join(bases.join(dotted.toDF("base", "base_dotted"), "base"), "container", "left")
    else:
        owner = owner.withColumn("base_dotted", F.lit(None).cast("string"))
    classes = found.filter("hit_type = 'class'").join(dotted.toDF("hit", "class_dotted"), "hit").select("module_id", F.col("name").alias("annotation"), "class_dotted")
    owner = owner.join(classes, ["module_id", "annotation"], "left")
    holder = F.when(F.col("rule") == "self", F.col("container_dotted")).when(F.col("rule") == "super", F.when(F.col("container_dotted").isNotNull(), F.col("base_dotted"))).otherwise(F.col("class_dotted"))
    owner = owner.withColumn("q", F.concat_ws(".", holder, "attr")).withColumn("q", F.when(holder.isNotNull() & F.col("attr").isNotNull(), F.col("q"))).join(scopes.named, "q", "left")
    keys = ["from", "side", "label"]
    why = F.when((F.col("rule") == "super") & (F.col("size") == 1), "builtin").when(F.col("q").isNotNull(), "unbound-attribute").when((F.col("rule") == "super") & F.col("attr").isNotNull() & F.col("container_dotted").isNotNull(), "unbound-super").otherwise("unresolved")
    via = F.when(F.col("rule") == "param", "annotation").otherwise(F.col("rule"))
    owned = owner.select(*keys, F.col("hit").alias("bound"), F.when(F.col("hit").isNotNull(), via).alias("via"), F.when(F.col("hit").isNull(), why).alias("why"), F.col("q").alias("qualified"))
    schemes = scopes.nodes.select(F.split("dotted", r"\.")[0].alias("first"), F.lit(True).alias("minted")).distinct()
    seen = asked.filter("rule = 'scope'").join(found.withColumnRenamed("name", "label"), ["module_id", "label"], "left")
    seen = seen.withColumn("first", F.split("kept", r"\.")[0]).join(schemes, "first", "left")
    bound = F.when(F.col("shadow_q").isNull(), F.col("hit"))
    why = F.when(F.col("shadow_q").isNotNull(), "unbound-attribute").when(F.col("kept").isNotNull(), F.when(F.col("first").isin(*standard), "stdlib").when(F.col("minted"), "missing").otherwise("unminted")).when((F.col("size") == 1) & F.col("head").isin(*BUILTINS), "builtin").otherwise("unresolved")
    free = seen.select(*keys, bound.alias("bound"), F.when(bound.isNotNull(), F.col("how")).alias("via"), F.when(bound.isNull(), why).alias("why"), F.coalesce("shadow_q", "kept").alias("qualified"))
    none = asked.filter("rule = 'none'").select(*keys, *[F.lit(None).cast("string").alias(c) for c in ("bound", "via")], F.lit("unresolved").alias("why"), F.lit(None).cast("string").alias("qualified"))
    out = edges.join(owned.unionByName(free).unionByName(none), keys)
    return out.select(F.when(F.col("side") == "src", F.col("bound")).otherwise(F.col("src")).alias("src"), F.when(F.col("side") == "dst", F.col("bound")).otherwise(F.col("dst")).alias("dst"), "edge_type", "line", "label", "via", "why", "qualified")
