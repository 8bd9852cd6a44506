"""The type-resolved tier: the class of a receiver, by scopes, declared types, `new`, casts, what calls, members and elements
give, type parameters and overloads; dispatch over heritage.

A type is a term: a class's key or another name, and in angles the terms of its arguments. ^i stands for a parameter of
the class that a member is declared in, ~i for one of a function, "?" for what has no name.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_external_file
from .graph import cut_lineage, merged

TIER = "type-resolved"
IMPLEMENTATIONS = 4  # of a call, as drawn
PARAMETERS = 8  # of a class or function that are told apart
# Names every runtime provides.
GLOBALS = "Math JSON console Object Array String Number Boolean Promise Date RegExp Map Set WeakMap WeakSet Symbol Reflect Proxy Intl BigInt Error process Buffer globalThis window document navigator localStorage sessionStorage performance crypto".split()


def exports(resolved: DataFrame, functions: DataFrame, types: DataFrame, renamed: DataFrame) -> DataFrame:
    """(file, name, def_file, def_name): what a name imported from a file stands for: its own names, those it exports renamed or as default, and re-exports through any number of files."""
    own = functions.filter("top and cls is null").select("file", "name").unionByName(types.select("file", "name")).distinct()
    known = own.select("file", "name", F.col("file").alias("def_file"), F.col("name").alias("def_name"))
    given = renamed.select("file", F.col("exported").alias("name"), F.col("local").alias("def_name"))
    known = known.unionByName(given.join(merged(own.withColumnRenamed("name", "def_name")), ["file", "def_name"]).select("file", "name", F.col("file").alias("def_file"), "def_name"))
    again = resolved.filter("kind = 're-export' and target is not null")
    named = again.select("file", "target", F.explode("names").alias("n")).select("file", "target", F.col("n.imported").alias("imported"), F.col("n.local").alias("local"))
    star = again.filter(F.col("star") & (F.size("names") == 0)).select("file", "target")
    if again.isEmpty():
        return known
    last = known
    while True:  # what is found is new each time, so circles of re-exports end too
        seen = last.select(F.col("file").alias("target"), F.col("name").alias("imported"), "def_file", "def_name")
        a = named.join(seen, ["target", "imported"]).select("file", F.col("local").alias("name"), "def_file", "def_name")
        b = star.join(seen, "target").select("file", F.col("imported").alias("name"), "def_file", "def_name")
        new = a.unionByName(b).distinct().join(merged(known), ["file", "name", "def_file", "def_name"], "left_anti")
        last = cut_lineage(new)
        if last.isEmpty():
            return known
        known = known.unionByName(last)


def scope(resolved: DataFrame, exported: DataFrame, functions: DataFrame, types: DataFrame) -> DataFrame:
    """(file, local, def_file, def_name): names a file can use, its own first."""
    own = functions.filter("top and cls is null").select("file", "name").unionByName(types.select("file", "name")).distinct()
    mine = own.select("file", F.col("name").alias("local"), F.col("file").alias("def_file"), F.col("name").alias("def_name"))
    names = resolved.filter("kind = 'import' and target is not null").select("file", "target", F.explode("names").alias("n"))
    taken = names.select("file", F.col("n.local").alias("local"), "target", F.col("n.imported").alias("imported"))
    there = exported.select(F.col("file").alias("target"), F.col("name").alias("imported"), "def_file", "def_name")
    return mine.unionByName(taken.join(merged(there), ["target", "imported"]).select("file", "local", "def_file", "def_name")).distinct()


# ---- terms

ARG = "[^<>,]+"
for _ in range(4):  # arguments nested deeper than this are not told apart
    ARG = f"[^<>,]+(?:<{ARG}(?:,{ARG})*>)?"
# What stands for unknown types, the plain ones, the containers by the place of what they hand on, and their methods.
ANY = ["?", "any", "unknown", "object"]
PLAIN = ["number", "string", "boolean"]
ARRAYS = ["Array", "ReadonlyArray"]
CONTAINERS = [*ARRAYS, "Set", "ReadonlySet", "Iterable", "IterableIterator", "AsyncIterable", "Generator"]
ONE = ["find", "findLast", "pop", "shift", "at"]
SAME = ["filter", "slice", "concat", "reverse", "sort", "toSorted", "toReversed"]


def class_key(file: Column, name: Column) -> Column:
    """A class as it stands in terms."""
    return F.concat(F.lit("@"), F.lower(F.hex(F.xxhash64(file, name))))


def head(term: Column) -> Column:
    return F.substring_index(term, "<", 1)


def args_of(term: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(term, "^[^<]*<(.*)>$", 1), F.lit(ARG), 0)


def arg(args: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(args, F.lit(i + 1)), F.lit("?"))


def filled(term: Column, args: Column, mark: str = "^") -> Column:
    """A term with arguments in the place of parameters."""
    numbered = F.transform(F.sequence(F.lit(0), F.lit(PARAMETERS - 1)), lambda i: F.struct(F.concat(F.lit(mark), i.cast("string")).alias("mark"), F.coalesce(F.get(args, i), F.lit("?")).alias("arg")))
    return F.aggregate(numbered, term, lambda now, x: F.replace(now, x["mark"], x["arg"]))


def known_term(term: Column) -> Column:
    return term.isNotNull() & ~head(term).isin(ANY) & ~term.startswith("~")


def handed_on(term: Column, kind: Column, name: Column) -> Column:
    """What a container of the language gives: its elements, to a loop or a function, and what its methods return."""
    args, top = args_of(term), head(term)
    return (
        F.when((kind == "element") & top.isin(CONTAINERS), arg(args, 0))
        .when((kind == "handed") & top.isin(CONTAINERS), arg(args, 0))
        .when((kind == "handed") & top.isin("Map", "ReadonlyMap"), arg(args, 1))
        .when((kind == "call") & top.isin(ARRAYS) & name.isin(ONE), arg(args, 0))
        .when((kind == "call") & top.isin(ARRAYS) & name.isin(SAME), term)
        .when((kind == "call") & top.isin("Map", "ReadonlyMap") & (name == "get"), arg(args, 1))
    )


def classes(types: DataFrame) -> DataFrame:
    """(key, t_file, t_cls, own): each class and interface, and its term as its own members see it."""
    once = types.groupBy("file", "name").agg(F.max("params").alias("params"))
    key = class_key(F.col("file"), F.col("name"))
    marks = F.when(F.col("params") > 0, F.concat(F.lit("<"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("params") - 1), lambda i: F.concat(F.lit("^"), i.cast("string"))), ","), F.lit(">"))).otherwise("")
    return once.select(key.alias("key"), F.col("file").alias("t_file"), F.col("name").alias("t_cls"), F.concat(key, marks).alias("own"))


def class_names(scoped: DataFrame, types: DataFrame) -> DataFrame:
    """(file, local, key): the names by which a file can use classes."""
    there = types.select(F.col("file").alias("def_file"), F.col("name").alias("def_name")).distinct()
    return scoped.join(there, ["def_file", "def_name"]).select("file", "local", class_key(F.col("def_file"), F.col("def_name")).alias("key")).distinct()


def resolved_terms(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(file, term, t): each term of rows (file, term), with the keys of the classes that its names mean in the file."""
    tokens = rows.filter("term is not null").distinct().select("file", "term", F.posexplode(F.regexp_extract_all("term", F.lit("[^<>,]+|[<>,]"), 0)).alias("at", "local"))
    said = tokens.join(names, ["file", "local"], "left").select("file", "term", F.struct("at", F.coalesce("key", "local").alias("n")).alias("n"))
    return said.groupBy("file", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["n"]), "").alias("t"))


def resolved_lists(rows: DataFrame, lists: str, names: DataFrame, id_: str) -> DataFrame:
    """(id, list): an array of terms per row, each with its class keys; marks of loose and rest parameters stay before them."""
    each = rows.select(id_, "file", F.posexplode(lists).alias("at", "raw")).withColumn("term", F.regexp_replace("raw", r"^(=|\.\.\.)", "")).withColumn("mark", F.regexp_extract("raw", r"^(=|\.\.\.)", 1))
    found = each.join(merged(resolved_terms(each.select("file", "term"), names)), ["file", "term"], "left")
    return found.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("mark", F.coalesce("t", F.lit(""))).alias("t")))), lambda x: x["t"]).alias(lists))


# ---- scopes


def nearest(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """(use_id, at): the scope of the nearest declaration of the name that a use (use_id, file, receiver, pos) is made of.

    Places where a name is declared nest like brackets. Of those of one name in one file, in order of their borders, each
    use stands in the last one opened at the depth that is reached there: two sorted passes over borders and uses, no
    pairs of them. Uses outside every declaration have no row. File level is scope -1.
    """
    places = bindings.filter("cls is null").select("file", "name", F.coalesce("scope", F.lit(-1)).alias("at"), F.coalesce("until", F.lit(2**31 - 1)).alias("until")).distinct()
    border = lambda pos, step, second: places.select("file", "name", F.col(pos).alias("pos"), F.lit(step).alias("step"), (-F.col(second)).alias("then"), "at", F.lit(None).cast("string").alias("use_id"))
    asked = uses.select("file", F.col("receiver").alias("name"), "pos", F.lit(0).alias("step"), F.lit(0).alias("then"), F.lit(None).cast("int").alias("at"), "use_id")
    # at one place closing comes first, inner ones before outer ones; then opening, outer ones first; then uses
    turn = F.when(F.col("step") < 0, 0).when(F.col("step") > 0, 1).otherwise(2)
    order = [F.col("pos"), F.col("turn"), F.col("then"), F.col("use_id")]
    rows = border("at", 1, "until").unionByName(border("until", -1, "at")).unionByName(asked).withColumn("turn", turn)
    deep = rows.withColumn("depth", F.sum("step").over(Window.partitionBy("file", "name").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter("step >= 0")
    last = F.last("at", ignorenulls=True).over(Window.partitionBy("file", "name", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return deep.withColumn("near", last).filter("step = 0 and depth > 0").select("use_id", F.col("near").alias("at"))


# ---- heritage


def parents(heritage: DataFrame, types: DataFrame, scoped: DataFrame) -> DataFrame:
    """(file, cls, kind, p_file, p_cls, p_args): what a class extends or implements, its arguments in the class's own parameters."""
    raw = heritage.withColumn("term", F.concat("parent", F.when(F.size("args") > 0, F.concat(F.lit("<"), F.array_join("args", ","), F.lit(">"))).otherwise("")))
    found = raw.join(resolved_terms(raw.select("file", "term"), class_names(scoped, types)), ["file", "term"]).withColumn("key", head(F.col("t")))
    return found.join(classes(types), "key").select("file", F.col("name").alias("cls"), "kind", F.col("t_file").alias("p_file"), F.col("t_cls").alias("p_cls"), args_of(F.col("t")).alias("p_args")).distinct()


def ancestry(types: DataFrame, heritage: DataFrame, scoped: DataFrame) -> DataFrame:
    """(file, cls, a_file, a_cls, distance, a_args): each class or interface, itself included, and what it extends or implements.

    a_args are the ancestor's arguments in the parameters of the class.
    """
    up = cut_lineage(parents(heritage, types, scoped).drop("kind").distinct()).withColumnsRenamed({"file": "a_file", "cls": "a_cls"})
    known = level = cut_lineage(classes(types).select(F.col("t_file").alias("file"), F.col("t_cls").alias("cls"), F.col("t_file").alias("a_file"), F.col("t_cls").alias("a_cls"), F.lit(0).alias("distance"), args_of(F.col("own")).alias("a_args")))
    for d in count(1):
        args = F.transform("p_args", lambda x: filled(x, F.col("a_args")))
        step = level.join(up, ["a_file", "a_cls"]).select("file", "cls", F.col("p_file").alias("a_file"), F.col("p_cls").alias("a_cls"), args.alias("a_args"))
        step = step.groupBy("file", "cls", "a_file", "a_cls").agg(F.lit(d).alias("distance"), F.min("a_args").alias("a_args"))
        level = cut_lineage(step.join(merged(known), ["file", "cls", "a_file", "a_cls"], "left_anti"))
        if level.isEmpty():
            return known
        known = known.unionByName(level)


# ---- receivers


def receiver_terms(uses: DataFrame, near: DataFrame, typed: DataFrame, types: DataFrame, scoped: DataFrame, heritage: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(use_id, r_term) of uses (use_id, file, cls, form, receiver) whose receiver's type is known.

    near: see nearest. A variable is what its nearest declaration says, and unknown where that has no type, whatever names
    stand further out; a name that is declared nowhere may be a class. A field is that of the class or its nearest ancestor.
    """
    return bound_terms(uses, near, typed, ancestors).unionByName(plain_terms(uses, near, types, scoped, heritage))


def bound_terms(uses: DataFrame, near: DataFrame, typed: DataFrame, ancestors: DataFrame) -> DataFrame:
    """receiver_terms of fields and variables, which the bindings known so far decide."""
    b = merged(typed.select(F.col("file").alias("b_file"), F.col("at").alias("b_at"), F.col("cls").alias("b_cls"), F.col("name").alias("b_name"), F.col("term").alias("b_term")))
    up = uses.filter("form = 'field'").join(ancestors, ["file", "cls"])
    field = up.join(b, (F.col("a_file") == F.col("b_file")) & (F.col("a_cls") == F.col("b_cls")) & (F.col("receiver") == F.col("b_name")))
    field = field.groupBy("use_id").agg(F.min_by(filled(F.col("b_term"), F.col("a_args")), F.struct("distance", "b_term")).alias("r_term"))
    bound = uses.filter("form = 'variable'").join(near, "use_id")
    variable = bound.join(b, (F.col("file") == F.col("b_file")) & (F.col("receiver") == F.col("b_name")) & (F.col("at") == F.col("b_at")) & F.col("b_cls").isNull())
    return field.unionByName(variable.groupBy("use_id").agg(F.min("b_term").alias("r_term")))


def plain_terms(uses: DataFrame, near: DataFrame, types: DataFrame, scoped: DataFrame, heritage: DataFrame) -> DataFrame:
    """receiver_terms of what is a class by its name, of super and of this: no binding decides them."""
    free = uses.filter("form = 'variable'").join(near.select("use_id"), "use_id", "left_anti").select("use_id", "file", "receiver").unionByName(uses.filter("form = 'typed'").select("use_id", "file", "receiver"))
    names = class_names(scoped, types).select(F.col("file").alias("n_file"), "local", F.col("key").alias("r_term"))
    direct = free.join(merged(names), (F.col("file") == F.col("n_file")) & (F.col("receiver") == F.col("local"))).groupBy("use_id").agg(F.min("r_term").alias("r_term"))
    above = parents(heritage, types, scoped).filter("kind = 'extends'")
    of = F.concat(class_key(F.col("p_file"), F.col("p_cls")), F.when(F.size("p_args") > 0, F.concat(F.lit("<"), F.array_join("p_args", ","), F.lit(">"))).otherwise(""))
    parent = uses.filter("form = 'super'").join(above, ["file", "cls"]).groupBy("use_id").agg(F.min(of).alias("r_term"))
    own = classes(types).select(F.col("t_file").alias("file"), F.col("t_cls").alias("cls"), F.col("own").alias("r_term"))
    this = uses.filter("form = 'this' and cls is not null").join(own, ["file", "cls"]).select("use_id", "r_term")
    return direct.unionByName(parent).unionByName(this)


def receivers(uses: DataFrame, bindings: DataFrame, typed: DataFrame, types: DataFrame, scoped: DataFrame, heritage: DataFrame, ancestors: DataFrame) -> DataFrame:
    """uses (use_id, file, cls, pos, form, receiver and more) with the type of the receiver, r_term, and its class, r_file and r_cls; null if unknown, the class also if it is no class of the tree."""
    near = nearest(uses.filter("form = 'variable'"), bindings)
    terms = receiver_terms(uses, near, typed, types, scoped, heritage, ancestors)
    place = classes(types).select("key", F.col("t_file").alias("r_file"), F.col("t_cls").alias("r_cls"))
    found = terms.withColumn("key", head(F.col("r_term"))).join(place, "key", "left").drop("key")
    return uses.join(found, "use_id", "left")


def accepts(params: Column, given: Column) -> Column:
    """Whether a signature takes arguments (term, ups), by their number and, where both are known, their types."""
    plain = lambda p: F.regexp_replace(p, r"^(=|\.\.\.)", "")
    rest = F.coalesce(F.try_element_at(params, F.lit(-1)), F.lit("")).startswith("...")
    must = F.size(F.filter(params, lambda p: ~p.startswith("=") & ~p.startswith("...")))
    fits = F.zip_with(params, given, lambda p, a: a.isNull() | p.isNull() | p.startswith("...") | head(plain(p)).isin(ANY) | plain(p).rlike("^[~^]") | a["term"].isin("?", "null") | ~(plain(p).startswith("@") | plain(p).isin(PLAIN)) | F.array_contains(a["ups"], head(plain(p))))
    spread = F.exists(given, lambda a: a["term"] == "...")
    return spread | ((F.size(given) >= must) & (rest | (F.size(given) <= F.size(params))) & F.forall(fits, lambda x: F.coalesce(x, F.lit(True))))


def inferred(term: Column, params: Column, given: Column) -> Column:
    """A term with a function's own parameters replaced by the types of the arguments that are declared as just them."""
    bare = F.transform(params, lambda p: F.regexp_replace(p, "^=", ""))
    each = F.transform(F.sequence(F.lit(0), F.lit(PARAMETERS - 1)), lambda i: F.array_position(bare, F.concat(F.lit("~"), i.cast("string"))).cast("int"))
    types = F.transform(each, lambda at: F.coalesce(F.when(at > 0, F.get(given, at - 1)["term"]), F.lit("?")))
    return filled(term, types, "~")


def signatures(functions: DataFrame, names: DataFrame) -> DataFrame:
    """Functions as callers see them: file, cls, name, top, line, gives (a term with class keys) and params. Where a function has signatures without a body, its body is not one."""
    group = ["file", "name", F.coalesce("cls", F.lit("")).alias("in_cls")]
    bare = functions.filter("not has_body").select(*group).distinct().withColumn("split", F.lit(True))
    rows = functions.withColumn("in_cls", F.coalesce("cls", F.lit(""))).join(bare, ["file", "name", "in_cls"], "left").filter("not has_body or split is null").filter("gives is not null")
    gives = resolved_terms(rows.select("file", F.col("gives").alias("term")), names).withColumnRenamed("term", "gives")
    params = resolved_lists(rows.select("id", "file", "params"), "params", names, "id")
    rows = rows.drop("params").join(merged(gives), ["file", "gives"]).join(merged(params), "id", "left")
    return rows.select("id", "file", "cls", "name", "top", "line", F.col("t").alias("gives"), F.coalesce("params", F.array().cast("array<string>")).alias("params"))


def typed_bindings(bindings: DataFrame, functions: DataFrame, types: DataFrame, scoped: DataFrame, heritage: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(file, at, cls, name, term): bindings whose type is known; at is the scope, -1 for the file.

    Those with a type of their own come first. One that comes from a call, a member or an element has the type which that
    gives: the return type of the first signature that takes the arguments, the declared type of a field, or what a
    container holds; found through the receiver, which may be such a binding itself, with the receiver's arguments in the
    place of the class's type parameters. So rounds follow until one finds nothing new; what was found first stays.
    """
    columns = ["file", "at", "cls", "name", "term"]
    names = cut_lineage(class_names(scoped, types))
    rows = bindings.withColumn("at", F.coalesce("scope", F.lit(-1)))
    own = rows.filter("term is not null")
    known = own.join(resolved_terms(own.select("file", "term"), names), ["file", "term"]).withColumn("term", F.col("t")).filter(known_term(F.col("term"))).select(columns).distinct()
    known = cut_lineage(known)
    due = rows.filter("term is null and via_kind is not null").drop("type", "term").distinct()
    key = F.concat_ws("@", "file", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("at", "cls", "name", "pos", "via_kind", "via_form", "via_receiver", "via_name")])
    due = cut_lineage(due.withColumn("use_id", key).dropDuplicates(["use_id"]))
    if due.isEmpty():
        return known
    ups = ancestors.groupBy(class_key(F.col("file"), F.col("cls")).alias("key")).agg(F.collect_set(class_key(F.col("a_file"), F.col("a_cls"))).alias("ups"))
    each = due.select("use_id", "file", F.posexplode("via_args").alias("i", "term"))
    each = each.join(resolved_terms(each.select("file", "term"), names), ["file", "term"]).withColumn("key", head(F.col("t"))).join(ups, "key", "left")
    given = each.groupBy("use_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("t").alias("term"), F.coalesce("ups", F.array("key")).alias("ups")))).alias("given"))
    none = F.array().cast("array<struct<i:int,term:string,ups:array<string>>>")
    due = cut_lineage(due.join(given, "use_id", "left").withColumn("given", F.coalesce("given", none)))
    calls = cut_lineage(signatures(functions, names))
    # plain names: functions the file can use, else those within it
    free = calls.filter("cls is null").select(F.col("file").alias("f_file"), F.col("name").alias("f_name"), F.col("top").alias("f_top"), F.col("line").alias("f_line"), "gives", "params")
    plain = due.filter("via_kind = 'call' and via_form = 'name'").select("use_id", "file", "via_name", "given")
    s = scoped.select(F.col("file").alias("s_file"), F.col("local").alias("s_local"), "def_file", "def_name")
    outer = plain.join(s, (F.col("file") == F.col("s_file")) & (F.col("via_name") == F.col("s_local"))).join(free.filter("f_top"), (F.col("def_file") == F.col("f_file")) & (F.col("def_name") == F.col("f_name"))).withColumn("p", F.lit(0))
    inner = plain.join(free.filter("not f_top"), (F.col("file") == F.col("f_file")) & (F.col("via_name") == F.col("f_name"))).withColumn("p", F.lit(1))
    taken = [x.select("use_id", "p", "f_line", "gives", "params", "given").filter(accepts(F.col("params"), F.col("given"))) for x in (outer, inner)]
    by_name = taken[0].unionByName(taken[1]).groupBy("use_id").agg(F.min_by(inferred(F.col("gives"), F.col("params"), F.col("given")), F.struct("p", "f_line", "gives")).alias("found"))
    by_name = cut_lineage(by_name)
    uses = due.filter("via_form <> 'name'").select("use_id", "file", F.col("via_cls").alias("cls"), "pos", F.col("via_form").alias("form"), F.col("via_receiver").alias("receiver"), "via_name", "via_kind", "given")
    near = cut_lineage(nearest(uses.filter("form = 'variable'"), bindings))
    members_ = calls.filter("cls is not null").select(F.col("file").alias("a_file"), F.col("cls").alias("a_cls"), F.col("name").alias("via_name"), F.col("line").alias("m_line"), "gives", "params")
    above = ancestors.join(classes(types), (F.col("file") == F.col("t_file")) & (F.col("cls") == F.col("t_cls"))).select("key", "a_file", "a_cls", "distance", "a_args")
    above, plain_ = cut_lineage(above), cut_lineage(plain_terms(uses, near, types, scoped, heritage))  # the same in every round
    uses = cut_lineage(uses)
    while True:
        held = uses.join(bound_terms(uses, near, known, ancestors).unionByName(plain_), "use_id").withColumn("key", head(F.col("r_term")))
        shared = held.select("use_id", handed_on(F.col("r_term"), F.col("via_kind"), F.col("via_name")).alias("found")).filter("found is not null")
        args = args_of(F.col("r_term"))
        up = held.join(above, "key").withColumn("args", F.transform("a_args", lambda x: filled(x, args)))
        called = up.filter("via_kind = 'call'").join(members_, ["a_file", "a_cls", "via_name"]).filter(accepts(F.col("params"), F.col("given")))
        gives = F.when(F.col("gives") == "this", F.col("r_term")).otherwise(inferred(filled(F.col("gives"), F.col("args")), F.col("params"), F.col("given")))
        called = called.groupBy("use_id").agg(F.min_by(gives, F.struct("distance", "m_line", "gives")).alias("found"))
        fields = known.filter("cls is not null").select(F.col("file").alias("a_file"), F.col("cls").alias("a_cls"), F.col("name").alias("via_name"), F.col("term").alias("f_term"))
        read = up.filter("via_kind = 'access'").join(merged(fields), ["a_file", "a_cls", "via_name"])
        read = read.groupBy("use_id").agg(F.min_by(filled(F.col("f_term"), F.col("args")), F.struct("distance", "f_term")).alias("found"))
        found = by_name.unionByName(shared).unionByName(called).unionByName(read).filter(known_term(F.col("found"))).groupBy("use_id").agg(F.min("found").alias("term"))
        last = cut_lineage(due.join(found, "use_id").select("use_id", *columns))
        if last.isEmpty():
            return known
        known = known.unionByName(last.select(columns))
        due, uses = (cut_lineage(x.join(last.select("use_id"), "use_id", "left_anti")) for x in (due, uses))


def members(located: DataFrame, functions: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(use_id, id, impl_ord): the bodies a member use may run: that of the class or its nearest ancestor, else implementations."""
    m = functions.filter("cls is not null").select(F.col("file").alias("m_file"), F.col("cls").alias("m_cls"), F.col("name").alias("m_name"), "id", "has_body", F.col("line").alias("m_line"))
    hit = located.filter("r_cls is not null").select("use_id", "r_file", "r_cls", "name")
    above = ancestors.withColumnsRenamed({"file": "r_file", "cls": "r_cls"})
    up = hit.join(above, ["r_file", "r_cls"]).select("use_id", "name", "r_file", "r_cls", "a_file", "a_cls", "distance")
    own = up.join(m, (F.col("a_file") == F.col("m_file")) & (F.col("a_cls") == F.col("m_cls")) & (F.col("name") == F.col("m_name")))
    nearest = own.groupBy("use_id").agg(F.min_by(F.struct("id", "has_body"), F.struct("distance", ~F.col("has_body"), "m_line", "id")).alias("n"))
    direct = nearest.filter("n.has_body").select("use_id", F.col("n.id").alias("id"), F.lit(0).alias("impl_ord"))
    open_ = hit.join(nearest.filter("not n.has_body").select("use_id"), "use_id")
    down = open_.join(ancestors.select(F.col("file").alias("i_file"), F.col("cls").alias("i_cls"), F.col("a_file").alias("r_file"), F.col("a_cls").alias("r_cls")), ["r_file", "r_cls"])
    bodies = m.filter(F.col("has_body") & ~is_external_file(F.col("m_file")))
    impls = down.join(bodies, (F.col("i_file") == F.col("m_file")) & (F.col("i_cls") == F.col("m_cls")) & (F.col("name") == F.col("m_name"))).select("use_id", "id", "m_file", "m_line").distinct()
    ranked = impls.withColumn("impl_ord", F.row_number().over(Window.partitionBy("use_id").orderBy("m_file", "m_line", "id")) - 1)
    return direct.unionByName(ranked.filter(F.col("impl_ord") < IMPLEMENTATIONS).select("use_id", "id", "impl_ord"))


def call_edges(calls: DataFrame, functions: DataFrame, bindings: DataFrame, typed: DataFrame, types: DataFrame, resolved: DataFrame, scoped: DataFrame, heritage: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(caller, call_ord, outcome, callee, impl_ord, text): every call once per possible callee; outcome in-repo, external or unresolved."""
    owner = functions.select(F.col("id").alias("caller"), "cls")
    uses = cut_lineage(calls.join(owner, "caller").withColumn("use_id", F.concat_ws("@", "caller", "ord")))
    located = cut_lineage(receivers(uses.filter("form <> 'name'"), bindings, typed, types, scoped, heritage, ancestors))
    by_member = members(located.select("use_id", "r_file", "r_cls", "name"), functions, ancestors)
    s = scoped.select(F.col("file").alias("s_file"), F.col("local").alias("s_local"), "def_file", "def_name")
    free = functions.filter("cls is null and has_body").select(F.col("file").alias("f_file"), F.col("name").alias("f_name"), "id", F.col("top").alias("f_top"), F.col("line").alias("f_line"))
    named = uses.filter("form = 'name' and kind = 'call'")
    placed = named.join(s, (F.col("file") == F.col("s_file")) & (F.col("name") == F.col("s_local"))).join(free, (F.col("def_file") == F.col("f_file")) & (F.col("def_name") == F.col("f_name"))).select("use_id", "id", F.lit(0).alias("p"), "f_line")
    inner = named.join(free.filter("not f_top"), (F.col("file") == F.col("f_file")) & (F.col("name") == F.col("f_name"))).select("use_id", "id", F.lit(1).alias("p"), "f_line")
    by_name = placed.unionByName(inner).groupBy("use_id").agg(F.min_by("id", F.struct("p", "f_line", "id")).alias("id")).withColumn("impl_ord", F.lit(0))
    ctor = functions.filter("name = 'constructor' and has_body").select(F.col("file").alias("c_file"), F.col("cls").alias("c_cls"), "id")
    made = uses.filter("kind = 'new' and form = 'name'").join(s, (F.col("file") == F.col("s_file")) & (F.col("name") == F.col("s_local")))
    above = ancestors.withColumnsRenamed({"file": "def_file", "cls": "def_name"})
    built = made.join(above, ["def_file", "def_name"]).join(ctor, (F.col("a_file") == F.col("c_file")) & (F.col("a_cls") == F.col("c_cls")))
    by_new = built.groupBy("use_id").agg(F.min_by("id", "distance").alias("id")).withColumn("impl_ord", F.lit(0))
    space = resolved.filter("kind = 'import' and target is not null").select(F.col("file").alias("n_file"), "target", F.explode("names").alias("n")).filter("n.imported = '*'").select("n_file", "target", F.col("n.local").alias("n_local"))
    spaced = uses.filter("form = 'variable'").join(space, (F.col("file") == F.col("n_file")) & (F.col("receiver") == F.col("n_local"))).join(free.filter("f_top"), (F.col("target") == F.col("f_file")) & (F.col("name") == F.col("f_name")))
    by_space = spaced.groupBy("use_id").agg(F.min_by("id", "f_line").alias("id")).withColumn("impl_ord", F.lit(0))
    found = by_member.unionByName(by_name).unionByName(by_new).unionByName(by_space)
    found = found.join(functions.select("id", F.col("file").alias("t_file")), "id").withColumn("out", is_external_file(F.col("t_file")))
    outside = resolved.filter("kind = 'import' and target is null").select(F.col("file").alias("o_file"), F.explode("names").alias("n")).select("o_file", F.col("n.local").alias("o_local")).distinct()
    head_ = F.coalesce("receiver", "name")
    marked = uses.join(found.select("use_id", "id", "impl_ord", "out"), "use_id", "left").join(outside, (F.col("file") == F.col("o_file")) & (head_ == F.col("o_local")), "left")
    declared = scoped.select(F.col("file").alias("d_file"), F.col("local").alias("d_local")).union(bindings.filter("cls is null and type is not null").select("file", "name")).distinct()
    marked = marked.join(merged(declared), (F.col("file") == F.col("d_file")) & (head_ == F.col("d_local")), "left")
    # of a type that is none of the tree's
    library = located.filter("r_cls is null and form in ('variable', 'field')").filter(~F.col("r_term").rlike("^[~^?]")).select("use_id", F.lit(True).alias("library"))
    marked = marked.join(library, "use_id", "left")
    outcome = (
        F.when(F.col("id").isNotNull() & ~F.col("out"), "in-repo")
        .when(F.col("id").isNotNull() | F.col("o_file").isNotNull() | F.coalesce("library", F.lit(False)), "external")
        .when((F.col("form") == "name") & F.col("d_file").isNull(), "external")
        .when((F.col("form") == "variable") & F.col("receiver").isin(GLOBALS), "external")
        .otherwise("unresolved")
    )
    rows = marked.withColumn("outcome", outcome)
    return rows.select("caller", F.col("ord").alias("call_ord"), "outcome", F.when(F.col("outcome") == "in-repo", F.col("id")).alias("callee"), "impl_ord", "text").distinct()
