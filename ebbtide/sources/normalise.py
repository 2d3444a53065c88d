"""Landing payloads to typed facts, dead letters and leftovers: one job with one tagged row for each outcome, driven by a spec for each signal.

landing: (tenant_id, received_ms, intake, path, query map, body). A spec names the list that holds the items, lists
below the items, the fields to take by paths with fallbacks, the tag field, and where a timestamp may be. A body is parsed
once, into a variant, and everything below is read from its binary form; what items need of the objects around them is taken
from these before their lists are dealt out. Each item becomes one row: a fact, or a letter with the reason why it is none. Nothing
is lost: keys that no field takes, at any level that fields reach into, are in ``extra`` under their dotted names, and
so are values of a wrong type and lists with members of one, which ``note`` names; keys beside the list, and those of
objects whose list is empty, are leftovers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sketch import sketch_key
from ..storage import durable

PROBES = ("", "{}", "[]")
SECRET_PARAMS = ("api_key", "application_key", "token")
TEXTS = "map<string,string>"


@dataclass(frozen=True)
class Spec:
    """``items``: JSON path of the list (None: the body is one item, or a list of items). ``fields``: name -> (type, paths...).

    A path from ``$`` is in the item, from ``$1`` in the object that holds the item's list, and so on up; ``levels`` are the
    lists below the first. ``times``: (path, milliseconds a unit, or 0 for RFC 3339 text, what to call it), the first good one counts.
    A ``string`` is a JSON string; of type ``text`` is any JSON, as text.
    """

    intake: str
    fields: dict[str, tuple[str, ...]]
    items: str | None = None
    envelope: dict[str, tuple[str, ...]] = field(default_factory=dict)  # taken from the body for every item
    required: tuple[str, ...] = ()
    tags: str | None = None
    times: tuple[tuple[str, int, str], ...] = ()
    keyed: str | None = None  # ``items`` is a map from this column's values to lists of items
    levels: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)  # query parameters that stand in for missing fields; their tags come first
    derive: dict[str, Callable[[], Column]] = field(default_factory=dict)
    strict: tuple[str, ...] = ()  # paths of the item where anything but a string makes it a letter


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it names it: inside lambdas nothing else shares results."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def multimap(pairs: Column) -> Column:
    """``key:value`` texts -> key to list of values in order; the first colon splits, a bare tag has the value ''."""
    clean = F.filter(F.coalesce(pairs, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    value = lambda x: F.when(F.contains(x, F.lit(":")), F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise("")
    halves = F.transform(clean, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), value(x).alias("value")))
    values = lambda s, k: F.transform(F.filter(s, lambda e: e["key"] == k), lambda e: e["value"])
    one_each = lambda s: F.map_from_arrays(s["key"], F.transform(s["value"], lambda v: F.array(v)))
    several = lambda s: let(F.array_distinct(s["key"]), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: values(s, k))))
    return let(halves, lambda s: F.when(F.size(F.array_distinct(s["key"])) == F.size(s), one_each(s)).otherwise(several(s)))


def steps(path: str) -> tuple[int, tuple[str | int, ...]]:
    """``$1.a.b\\.c[0]`` -> (1, ("a", "b.c", 0))."""
    up, rest = re.fullmatch(r"\$(\d*)(.*)", path).groups()
    keys = [int(i) if i else k.replace("\\.", ".") for k, i in re.findall(r"\.((?:\\.|[^.\[])+)|\[(\d+)\]", rest)]
    return int(up or 0), tuple(keys)


def below(held: Column | str, keys: tuple[str | int, ...], kind: str) -> Column:
    """What is below these keys, as a type; nothing on the way there is copied.

    Names are asked for as members of a struct: a path that ends nowhere is an exception within ``try_variant_get``, which costs more than a walk."""
    first = next((n for n, k in enumerate(keys) if not isinstance(k, int)), len(keys))
    last = next((n for n in range(first, len(keys)) if isinstance(keys[n], int)), len(keys))
    for k in reversed(keys[first:last]) if last == len(keys) else ():
        kind = f"struct<`{k.replace('`', '``')}`:{kind}>"
    rest = keys[:first] if last == len(keys) else keys
    found = F.try_variant_get(held, "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in rest), kind)
    for k in keys[len(rest) :]:
        found = found.getField(k)
    return found


def there(held: Column, *keys: str | int) -> Column:
    """The variant below these keys; null where there is none, and for a JSON null."""
    found = below(held, keys, "variant")
    return F.when(~F.is_variant_null(found), found)


def listed(held: Column) -> Column:
    """A JSON list's members; null for anything else."""
    return F.try_variant_get(held, "$", "array<variant>")


def members(held: Column) -> Column:
    """A JSON object's members; null for anything else."""
    return F.try_variant_get(held, "$", "map<string,variant>")


def is_text(held: Column) -> Column:
    return F.coalesce(F.schema_of_variant(held) == "STRING", F.lit(False))


def tag_texts(raw: Column) -> Column:
    """Tags as one comma-separated text."""
    return F.split(raw, r",\s*")


def typed(raw: Column, kind: str) -> Column:
    """A scalar of a variant, which a number or flag written as text also gives."""
    if kind == "variant":
        return raw
    text = raw.cast("string")
    if kind == "u64":  # the 64 bits as a signed number
        whole = text.try_cast("decimal(20,0)")
        wrapped = F.when(whole >= F.lit(str(1 << 63)).cast("decimal(20,0)"), whole - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(whole)
        return F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("bigint")).when(text.rlike("^[0-9]+$"), wrapped.try_cast("bigint"))
    if kind.startswith(("array", "map", "struct")):
        return F.try_variant_get(raw, "$", kind)
    if kind == "string":
        return F.when(is_text(raw), text)
    return text if kind == "text" else text.try_cast(kind)


def gaps(kind: T.DataType, made: Column) -> Column:
    """Whether a value, or any member of it at any depth, is null: only then can anything be of a wrong type."""
    inner = F.lit(False)
    if isinstance(kind, T.ArrayType):
        inner = F.exists(made, lambda x: gaps(kind.elementType, x))
    elif isinstance(kind, T.MapType):
        inner = F.exists(F.map_values(made), lambda x: gaps(kind.valueType, x))
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            inner = inner | gaps(f.dataType, made[f.name])
    return made.isNull() | inner


def unfit(kind: T.DataType, raw: Column, made: Column) -> Column:
    """Whether a value, or any member of it at any depth, is there and was not of the type asked for."""
    missing = made.isNull() & raw.cast("string").isNotNull()
    if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(missing, F.lit(False))
    if isinstance(kind, T.ArrayType):
        pairs = F.arrays_zip(listed(raw).alias("raw"), made.alias("made"))
        inner = F.exists(pairs, lambda p: unfit(kind.elementType, p["raw"], p["made"]))
    elif isinstance(kind, T.MapType):
        inner = F.exists(F.map_entries(members(raw)), lambda e: unfit(kind.valueType, e["value"], F.try_element_at(made, e["key"])))
    else:
        any_of = lambda held: reduce(lambda a, b: a | b, [unfit(f.dataType, held[f.name], made[f.name]) for f in kind.fields], F.lit(False))
        inner = let(F.try_variant_get(raw, "$", _ddl({f.name: "variant" for f in kind.fields})), any_of)
    return F.coalesce(gaps(kind, made) & (missing | F.coalesce(inner, F.lit(False))), F.lit(False))


PAIRS = "array<struct<key:string,value:string>>"


def last_of(pairs: Column) -> Column:
    """A map of (key, value) pairs; of pairs with one key the last counts."""
    return let(pairs, last_of_given)


def last_of_given(pairs: Column) -> Column:
    """As ``last_of``, of pairs that stand in a column already."""
    last = lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1)["value"]
    repeated = let(F.array_distinct(pairs["key"]), lambda keys: F.map_from_arrays(keys, F.transform(keys, last)))
    return F.when(F.size(pairs) == 0, F.create_map().cast(TEXTS)).when(F.size(F.array_distinct(pairs["key"])) == F.size(pairs), F.map_from_entries(pairs)).otherwise(repeated)


KEYS = "map<string,struct<>>"  # an object's keys alone: of its members nothing is copied


@dataclass(frozen=True)
class Opened:
    """What is below a variant. Each path is followed in the binary form, down to what is asked for and no further."""

    column: str
    start: tuple = ()  # where the variant begins in the column

    def get(self, keys: tuple, kind: str) -> Column:
        return below(self.column, (*self.start, *keys), kind)

    def raw(self, keys: tuple) -> Column:
        """The variant at a path, a JSON null too."""
        return self.get(keys, "variant") if keys or self.start else F.col(self.column)

    def is_object(self, at: tuple = ()) -> Column:
        return self.get(at, "struct<>").isNotNull()

    def split(self, taken: list[tuple], at: tuple = ()) -> tuple[set, list]:
        """Keys of an object, or list, that paths end at, and keys that paths go through."""
        mine = [p[len(at) :] for p in taken if len(p) > len(at) and p[: len(at)] == at]
        leaves = {p[0] for p in mine if len(p) == 1}
        return leaves, sorted({p[0] for p in mine if len(p) > 1} - leaves, key=str)

    def entered(self, taken: list[tuple], at: tuple) -> Column:
        """Whether there is a list or an object, whichever the paths through it want."""
        as_list = any(isinstance(k, int) for part in self.split(taken, at) for k in part)
        return self.get(at, "array<struct<>>").isNotNull() if as_list else self.is_object(at)

    def bare(self, taken: list[tuple], more: Column | None = None, at: tuple = ()) -> Column:
        """Whether ``untaken`` has nothing, but for ``more`` members, by the keys alone; what is hard to tell is false."""
        leaves, through = self.split(taken, at)
        if any(isinstance(k, int) for k in (*leaves, *through)):
            return F.lit(False)
        number = F.lit(0) if more is None else more
        for k in through:
            number = number + self.entered(taken, (*at, k)).cast("int")
        others = F.array_except(F.map_keys(self.get(at, KEYS)), F.array(*map(F.lit, sorted(leaves))).cast("array<string>"))
        fine = F.coalesce(F.size(others) == number, F.lit(True))
        for k in through:
            fine = fine & self.bare(taken, None, (*at, k))
        return fine

    def objects(self, taken: list[tuple], at: tuple = ()) -> list[tuple]:
        """The objects that ``untaken`` looks through, lists not among them."""
        leaves, through = self.split(taken, at)
        mine = [] if any(isinstance(k, int) for k in leaves | set(through)) else [at]
        return mine + [x for k in through for x in self.objects(taken, (*at, k))]

    def untaken(self, taken: list[tuple], before: str = "", at: tuple = (), wholes: dict[tuple, str] | None = None) -> list[Column]:
        """Lists of (key, value): what no taken path covers in an object, or list, and in those that paths go through.

        ``wholes`` are columns with the members of the objects; only what is left over of these is looked at."""
        leaves, through = self.split(taken, at)
        name = F.lit(before + "".join(f"{k}." for k in at))
        pair = lambda key, held: F.struct(F.concat(name, key).alias("key"), held.cast("string").alias("value"))
        if wholes and at in wholes:
            whole = F.col(wholes[at])
            others = F.array_except(F.map_keys(whole), F.array(*map(F.lit, sorted(leaves)), *[F.when(self.entered(taken, (*at, k)), F.lit(k)) for k in through]).cast("array<string>"))
            rest = F.transform(others, lambda k: pair(k, F.try_element_at(whole, k)))
        else:
            if any(isinstance(k, int) for k in leaves | set(through)):
                entries = F.transform(self.get(at, "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
            else:
                entries = F.map_entries(self.get(at, "map<string,variant>"))
            left = lambda e: ~e["key"].isin(*map(str, leaves)) if leaves else F.lit(True)
            for k in through:
                left = (lambda f, k: lambda e: f(e) & ~((e["key"] == str(k)) & self.entered(taken, (*at, k))))(left, k)
            rest = F.transform(F.filter(entries, left), lambda e: pair(e["key"], e["value"]))
        out = [F.coalesce(F.filter(rest, lambda e: e["value"].isNotNull()), F.array().cast(PAIRS))]
        for k in through:
            out += self.untaken(taken, before, (*at, k), wholes)
        return out


def _room(shape: dict, keys: tuple, kind: str) -> bool:
    """Whether one struct can also hold what is at these keys: nothing above or below it is asked for, and no name differs by case only."""
    for n, k in enumerate(keys):
        if k not in shape:
            return all(k.lower() != other.lower() for other in shape)
        if n == len(keys) - 1 or not isinstance(shape[k], dict):
            return n == len(keys) - 1 and shape[k] == kind
        shape = shape[k]
    return False


def _ddl(shape: dict | str) -> str:
    return shape if isinstance(shape, str) else "struct<" + ",".join(f"`{k.replace('`', '``')}`:{_ddl(v)}" for k, v in shape.items()) + ">"


def walked(held: Opened, wanted: list[tuple[tuple, str]], name: str) -> tuple[dict[str, Column], Callable[[tuple, str], Column]]:
    """Columns to add, called ``name`` and a number, and what then gives the value below keys as a type.

    One walk through the members finds all that is wanted of them, while a search for each costs the more the fewer are there.
    Paths through lists are followed by themselves."""
    shapes: list[dict] = []
    spot: dict[tuple[tuple, str], int] = {}
    for keys, kind in dict.fromkeys(wanted):
        if not keys or any(isinstance(k, int) for k in keys):
            continue
        n = next((n for n, shape in enumerate(shapes) if _room(shape, keys, kind)), len(shapes))
        shapes += [{}] if n == len(shapes) else []
        at = shapes[n]
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        at[keys[-1]], spot[keys, kind] = kind, n

    def value(keys: tuple, kind: str) -> Column:
        if (keys, kind) not in spot:
            return held.raw(keys) if kind == "variant" else held.get(keys, kind)
        out = F.col(f"{name}{spot[keys, kind]}")
        for k in keys:
            out = out.getField(k)
        return out

    return {f"{name}{n}": held.get((), _ddl(shape)) for n, shape in enumerate(shapes)}, value


def single(kind: str) -> bool:
    """Whether it is the type of one value, not of a list or an object, which may be large."""
    return kind != "variant" and not kind.startswith(("array", "map", "struct"))


def given(found: Column) -> Column:
    """A variant, or null for a JSON null."""
    return F.when(~F.is_variant_null(found), found)


LETTER = "struct<reason:string,body:string,note:string>"


def _letter(reason: Column | str, body: Column, note: Column | None = None) -> Column:
    return F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), body.alias("body"), (F.lit("") if note is None else note).alias("note"))


def _parts(carried: dict[str, str], items: Column | None = None, letter: Column | None = None, rest: Column | None = None, **more) -> Column:
    """A list of parts: items, variants, each with the columns ``more``; or one letter; or one list of leftover pairs."""
    given = {"item": lambda x: x, **{k: (lambda c: lambda x: c)(c) for k, c in more.items()}} if items is not None else {}
    given |= {"letter": lambda x: letter} if letter is not None else {}
    given |= {"rest": lambda x: rest} if rest is not None else {}
    kinds = {"item": "variant", "letter": LETTER, "rest": PAIRS, **carried}
    one = lambda x: F.struct(*[(given[k](x) if k in given else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])
    return F.transform(items, one) if items is not None else F.array(one(None))


def _some(pairs: list[Column], carried: dict[str, str]) -> Column:
    """A part for the pairs, if there are any."""
    none = F.filter(_parts(carried), lambda _: F.lit(False))
    return let(F.concat(*pairs), lambda p: F.when(F.size(p) > 0, _parts(carried, rest=p)).otherwise(none))


def staying(made: Column) -> Column:
    """``made``, which no filter above is moved below of: the number of a task is part of it, and what it comes from is worked out once."""
    return F.when(F.spark_partition_id() >= 0, made)


def _opened(landing: DataFrame, spec: Spec, beside: tuple[str, ...], items_only: bool = False, rest_only: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """A row for each innermost item, letter or list of leftover pairs, and the columns of paths into outer objects.

    A body is framed by lines, of either ending, or whole. With ``items_only`` lists are dealt out as they are, without the rest,
    and with ``rest_only`` no items or letters are, unless there are levels below them."""
    landing.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of members with one name the last counts
    landing.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # longer methods the JVM never compiles
    landing = landing.where(F.col("intake") == spec.intake).withColumn("body", F.btrim("body", F.lit(" \t\n\x0b\f\r")))
    body = F.col("body")
    framed = ~body.startswith("[") & (body.contains("\n") | body.contains("\r")) & body.rlike(r"\}\s*[\r\n]\s*\{")
    lines = F.when(framed, F.split(body, r"\s*[\r\n]+\s*")).otherwise(F.array(body))
    docs = landing.select("tenant_id", "received_ms", "intake", "path", "query", F.explode(lines).alias("doc")).where("doc <> ''")
    # in brackets, since the parser passes over what follows a whole value
    docs = docs.withColumn("parsed", F.try_parse_json(F.concat(F.lit("["), "doc", F.lit("]"))))
    outer = Opened("parsed", (0,))
    base = ["tenant_id", "received_ms", "intake", "path", "query", *(f"e_{n}" for n in spec.envelope)]
    asked = [steps(p)[1] for _, *ps in spec.envelope.values() for p in ps]
    taken = [*asked, *([steps(spec.items)[1]] if spec.items else []), *(steps(f"$.{k}")[1] for k in beside)]
    if spec.envelope:
        made, raw = walked(outer, [(steps(p)[1], "variant") for kind, *ps in spec.envelope.values() if single(kind) for p in ps], "o_")
        docs = docs.withColumns(made)
        docs = docs.withColumns({f"e_{n}": _first(kind, [given(raw(steps(p)[1], "variant")) if len(ps) > 1 or kind == "variant" else raw(steps(p)[1], "variant") for p in ps]) for n, (kind, *ps) in spec.envelope.items()})
    carried: dict[str, str] = {}
    if spec.items:
        holder = steps(spec.items)[1]
        around = _some(outer.untaken(taken), carried)
        docs = docs.withColumn("list", F.map_entries(outer.get(holder, "map<string,variant>")) if spec.keyed else outer.get(holder, "array<variant>"))
    else:
        around = F.filter(_parts(carried), lambda _: F.lit(False))
        docs = docs.withColumn("list", F.coalesce(outer.get((), "array<variant>"), F.when(outer.is_object(), listed(F.col("parsed")))))
    reason = F.when(outer.raw(()).isNull(), "decode_error").otherwise("unexpected_shape")
    if spec.keyed:
        carried = {f"f_{spec.keyed}": "string"}
        around = _some(outer.untaken(taken), carried)
        one = lambda e: F.struct(e["value"].alias("item"), *[F.lit(None).cast(k).alias(n) for n, k in (("letter", LETTER), ("rest", PAIRS))], e["key"].alias(f"f_{spec.keyed}"))
        whole = F.concat(F.transform("list", one), around)
    else:
        whole = F.concat(_parts(carried, F.col("list")), around)
    if rest_only and not spec.levels:
        rows = docs.select(*base, F.inline(around))
    elif items_only:
        rows = docs.withColumn("list", staying(F.col("list"))).select(*base, F.explode("list").alias("item"))
        if spec.keyed:
            rows = rows.select(*base, F.col("item.value").alias("item"), F.col("item.key").alias(f"f_{spec.keyed}"))
    else:
        rows = docs.select(*base, F.inline(F.when(F.col("list").isNull(), F.concat(_parts(carried, letter=_letter(reason, F.col("doc"))), around)).otherwise(whole)))
    found: dict[str, str] = {}
    for n, key in enumerate(("", *spec.levels) if spec.keyed else spec.levels):
        up = len(spec.levels) - n
        paths = sorted({p for _, *ps in spec.fields.values() for p in ps if steps(p)[0] == up}) if key else []
        fresh = {p: f"u_{len(found) + k}" for k, p in enumerate(paths)}
        if key:
            passed_by = [*(steps(p)[1] for p in paths), (key,)]
            inside = Opened("item")
            made, raw = walked(inside, [(steps(p)[1], "variant") for kind, *ps in spec.fields.values() if single(kind) for p in ps if p in fresh], "o_")
            rows = rows.withColumns(made) if made else rows
            rows = rows.withColumns({c: raw(steps(p)[1], "variant") for p, c in fresh.items()})
            rows = rows.withColumns({**{c: given(F.col(c)) for c in fresh.values()}, f"p_{up}": F.concat(*inside.untaken(passed_by, f"${up}.")), "list": inside.get((key,), "array<variant>")})
            bad = ~inside.is_object() | (F.col("list").isNull() & given(inside.raw((key,))).isNotNull())
        else:
            rows = rows.withColumn("list", listed(F.col("item")))
            bad = F.col("list").isNull()
        after = carried | dict.fromkeys(fresh.values(), "variant") | ({f"p_{up}": PAIRS} if key else {})
        if items_only:
            rows = rows.withColumn("list", staying(F.col("list"))).select(*base, *after, F.explode("list").alias("item"))
            carried, found = after, found | fresh
            continue
        made = {c: F.col(c) for c in after}
        passed = F.array(F.struct(*[F.col(c) if c in ("item", "letter", "rest", *carried) else F.lit(None).cast(kind).alias(c) for c, kind in {"item": "variant", "letter": LETTER, "rest": PAIRS, **after}.items()]))
        empty = F.when(F.size(F.col(f"p_{up}")) > 0, _parts(after, rest=F.col(f"p_{up}"))).otherwise(F.filter(passed, lambda _: F.lit(False))) if key else F.filter(passed, lambda _: F.lit(False))
        parts = F.when(F.col("item").isNull(), passed).when(bad, _parts(after, letter=_letter("unexpected_shape", F.to_json("item")))).when(F.coalesce(F.size("list"), F.lit(0)) <= 0, empty)
        rows = rows.select(*base, F.inline(parts.otherwise(_parts(after, F.col("list"), **made))))
        carried, found = after, found | fresh
    return rows, found


def _first(kind: str, found: list[Column]) -> Column:
    """The first that is there and not empty, else the first that is there; of strings, only strings count, if there is one."""
    if len(found) == 1:
        return found[0]
    good = [F.when(is_text(x), x) if kind == "string" else x for x in found]
    return F.coalesce(*[F.when(x.cast("string") != "", x) for x in good], *good, *found)


def outcomes(landing: DataFrame, spec: Spec, beside: tuple[str, ...] = ()) -> DataFrame:
    """(tenant_id, received_ms, intake, path, query, tag, fact, letter, rest): one row for each fact, letter or leftover map, from one pass.

    ``fact`` is the typed struct; ``timestamp_source`` in it says whose clock the time is; ``note`` names members of a wrong type.
    ``beside`` are keys of the body that other specs of it take. A JSON null in place of an item is a letter.
    """
    rows, names = told(landing, spec, beside)
    fact = F.struct(*[F.col(f"x_{n}").alias(n) for n in names])
    return rows.select(*LANDED, "tag", F.when(F.col("tag") == "fact", fact).alias("fact"), "letter", F.when(F.col("tag") == "rest", last_of(F.col("rest"))).alias("rest"))


LANDED = ("tenant_id", "received_ms", "intake", "path", "query")


def told(landing: DataFrame, spec: Spec, beside: tuple[str, ...] = (), items_only: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows with ``tag``, ``letter``, ``rest`` (pairs) and a column ``x_`` for each of the names, which are given too.

    The columns stand side by side, so that of facts only what is asked for is worked out. ``items_only``: no letters or
    leftovers of the objects around the items.
    """
    rows, found = _opened(landing, spec, beside, items_only)
    item = F.col("item")
    paths = [p for _, *ps in spec.fields.values() for p in ps]
    tagged = [spec.tags] if spec.tags else []
    own_paths = sorted({p for p in (*paths, *tagged, *(p for p, _, _ in spec.times), *spec.strict) if not steps(p)[0]})
    inside = Opened("item")
    kinds = {n: x[0] for n, x in (spec.fields | spec.envelope).items()}
    #: Fields of one path in the item, which are read from it as what they are, without a variant on the way.
    plain = {n: steps(ps[0])[1] for n, (kind, *ps) in spec.fields.items() if len(ps) == 1 and kind not in ("variant", "string") and not steps(ps[0])[0]}
    scalar = {n for n in plain if single(kinds[n])}
    small = [p for n, (kind, *ps) in spec.fields.items() if single(kind) and n not in plain for p in ps if not steps(p)[0]]
    made, read = walked(inside, [*((plain[n], "string") for n in sorted(scalar)), *((steps(spec.tags)[1], "array<variant>") for _ in range(bool(spec.tags and not steps(spec.tags)[0]))), *((steps(p)[1], "variant") for p in (*small, *(p for p, _, _ in spec.times), *spec.strict) if not steps(p)[0])], "s_")
    rows = rows.withColumns(made) if made else rows
    rows = rows.withColumns({f"g_{k}": read(steps(p)[1], "variant") for k, p in enumerate(own_paths)})
    rows = rows.withColumns({f"a_{k}": given(F.col(f"g_{k}")) for k in range(len(own_paths))})
    at = lambda p: F.col(found[p] if steps(p)[0] else f"a_{own_paths.index(p)}")
    rows = rows.withColumns({f"v_{n}": _first(kind, [at(p) for p in ps]) for n, (kind, *ps) in spec.fields.items() if n not in plain} | {f"v_{n}": F.col(f"e_{n}") for n in spec.envelope} | {f"v_{n}": read(plain[n], "string") for n in sorted(scalar)})
    value = lambda n: inside.raw(plain[n]) if n in plain and n not in scalar else F.col(f"v_{n}")
    rows = rows.withColumns({f"f_{n}": inside.get(plain[n], kind) if n in plain and n not in scalar else typed(value(n), kind) for n, kind in kinds.items()})
    shown = lambda p: "".join(f"{k}." for k in steps(p)[1]).rstrip(".") or "item"
    wrong = {shown((spec.fields | spec.envelope)[n][1]): (unfit(_type(kind), value(n), F.col(f"f_{n}")), value(n), n in spec.fields) for n, kind in kinds.items() if kind != "text"}
    tags = F.array().cast("array<string>")
    if spec.tags:
        rows = rows.withColumn("tag_list", listed(at(spec.tags)) if steps(spec.tags)[0] else read(steps(spec.tags)[1], "array<variant>"))
        many = F.col("tag_list")
        if steps(spec.tags)[0]:
            held = whole_tags = at(spec.tags)
        else:  # looked up only where it is no list, or has members of a wrong type
            whole_tags = given(inside.raw(steps(spec.tags)[1]))
            rows = rows.withColumn("tag_held", F.when(many.isNull(), read(steps(spec.tags)[1], "variant")))
            held = given(F.col("tag_held"))
        listed_tags = F.transform(F.filter(many, is_text), lambda x: x.cast("string"))
        own = F.coalesce(listed_tags, F.when(is_text(held), tag_texts(held.cast("string"))), F.array().cast("array<string>"))
        odd = F.coalesce(F.exists(many, lambda x: ~is_text(x) & ~F.is_variant_null(x)), held.isNotNull() & ~is_text(held), F.lit(False))
        wrong[shown(spec.tags)] = (odd, whole_tags, True)
        first = F.coalesce(tag_texts(F.try_element_at("query", F.lit(spec.defaults["tags"]))), F.array().cast("array<string>")) if "tags" in spec.defaults else None
        tags = multimap(own if first is None else F.concat(first, own))
    rows = rows.withColumns({f"w_{k}": w for k, (w, _, _) in enumerate(wrong.values())})
    note = F.concat_ws(",", *[F.when(F.col(f"w_{k}"), name) for k, name in enumerate(wrong)]) if wrong else F.lit("")
    lacking = item.isNull()
    for n in spec.required:
        lacking = lacking | F.col(f"f_{n}").isNull()
    below_item = [steps(p)[1] for p in (*paths, *([spec.tags] if spec.tags else []), *(p for p, _, _ in spec.times)) if not steps(p)[0]]
    if any(p and isinstance(p[0], int) for p in below_item) or () not in below_item:
        lacking = lacking | ~inside.entered(below_item, ())
    else:
        lacking = lacking | F.is_variant_null(item)
    for p in spec.strict:
        lacking = lacking | (at(p).isNotNull() & ~is_text(at(p)))
    rows = rows.withColumn("lacking", lacking)
    lacking = F.col("lacking")
    noted = F.lit(False)

    def one(key: Column, value: Column, when: Column) -> Column:
        nonlocal noted
        noted = noted | when
        return F.struct(F.when(when, key).alias("key"), F.when(when, value.cast("string")).alias("value"))

    several = {shown(ps[0]): (n, ps) for n, (_, *ps) in spec.fields.items() if len(ps) > 1}
    kept = [one(F.lit(name), v, F.col(f"w_{k}")) for k, (name, (_, v, own)) in enumerate(wrong.items()) if own and name not in several]
    marks = {name: F.col(f"w_{k}") for k, name in enumerate(wrong)}
    for name, (n, ps) in several.items():  # of several spellings, the one that is of a wrong type and those that another stands before
        other = lambda p, n=n: ~at(p).cast("string").eqNullSafe(F.col(f"v_{n}").cast("string"))
        kept += [one(F.lit(shown(p)), at(p), at(p).isNotNull() & (marks.get(name, F.lit(False)) | other(p))) for p in ps]
    out = {n: F.coalesce(F.col(f"f_{n}"), F.nullif(F.try_element_at("query", F.lit(spec.defaults[n])), F.lit(""))) if n in spec.defaults else F.col(f"f_{n}") for n in [*kinds, *([spec.keyed] if spec.keyed else [])]}
    if spec.tags:
        out["tags"] = F.when(~lacking, tags)
    used = F.lit(None).cast("string")
    if spec.times:
        sent = []
        for path, unit, label in spec.times:
            text = at(path).cast("string")
            clock = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ].*([Zz]|[+-]\d\d:\d\d)$"), F.unix_millis(text.try_cast("timestamp")))
            ms = clock if unit == 0 else F.when(text.try_cast("double") > 0, (text.try_cast("double") * unit).try_cast("bigint"))
            sent.append(F.when(ms.isNotNull(), F.struct(ms.alias("ms"), F.lit(label).alias("label"), F.lit(shown(path)).alias("key"))))
        rows = rows.withColumn("sent", F.coalesce(*sent))
        out["t_ms"] = F.coalesce("sent.ms", "received_ms")
        out["timestamp_source"] = F.coalesce("sent.label", F.lit("arrival"))
        used = F.col("sent.key")
    taken = [steps(p)[1] for p in (*paths, *([spec.tags] if spec.tags else [])) if not steps(p)[0]]
    clocks = sorted({steps(p)[1] for p, _, _ in spec.times if len(steps(p)[1]) == 1 and not steps(p)[0]} - set(taken))
    none_left = ~noted & (F.lit(True) if () in taken else inside.bare(taken, F.coalesce(used.isin(*[k for (k,) in clocks]).cast("int"), F.lit(0)) if clocks else None))
    for k in range(len(spec.levels)):
        none_left = none_left & (F.coalesce(F.size(F.col(f"p_{k + 1}")), F.lit(0)) <= 0)
    # each step looks only at rows that the one before left something in
    rows = rows.withColumns({"noted": noted, "none_left": none_left})
    wholes = {} if () in taken else {at: f"m_{k}" for k, at in enumerate(inside.objects(taken))}
    rows = rows.withColumns({c: F.when(~F.col("none_left"), inside.get(at, "map<string,variant>")) for at, c in wholes.items()})
    lists = [] if () in taken else inside.untaken(taken, wholes=wholes)
    lists += [F.coalesce(F.col(f"p_{k + 1}"), F.array().cast(PAIRS)) for k in range(len(spec.levels))]
    lists += [F.when(F.col("noted"), F.filter(F.array(*kept), lambda e: e["key"].isNotNull())).otherwise(F.array().cast(PAIRS))] if kept else []
    pairs = F.concat(*lists) if lists else F.array().cast(PAIRS)
    if spec.times:
        pairs = F.filter(pairs, lambda e: ~e["key"].eqNullSafe(used))
    rows = rows.withColumn("pairs", F.when(~F.col("none_left"), pairs))
    out["note"], out["extra"] = note, F.when(~lacking, F.when(F.col("none_left"), F.create_map().cast(TEXTS)).otherwise(last_of_given(F.col("pairs"))))
    tag = F.when(lacking, "letter").otherwise("fact")
    letter = F.lit(None).cast(LETTER)
    if not items_only:
        tag = F.when(F.col("letter").isNotNull(), "letter").when(F.col("rest").isNotNull(), "rest").otherwise(tag)
        letter = F.col("letter")
    own = F.when(lacking, _letter("unexpected_shape", F.coalesce(F.to_json("item"), F.lit("null")), note))
    if not items_only:
        own = F.coalesce(letter, F.when(F.col("rest").isNull(), own))
    rest = F.lit(None).cast(PAIRS) if items_only else F.col("rest")
    return rows.select(*LANDED, staying(tag).alias("tag"), own.alias("letter"), rest.alias("rest"), *[c.alias(f"x_{n}") for n, c in out.items()]), list(out)


def _type(kind: str) -> T.DataType:
    return T.LongType() if kind == "u64" else T.DataType.fromDDL(kind)


def facts_of(made: DataFrame, spec: Spec) -> DataFrame:
    return _derived(made.where("tag = 'fact'").select("tenant_id", "received_ms", "fact.*"), spec)


def _derived(facts: DataFrame, spec: Spec) -> DataFrame:
    for n, make in spec.derive.items():
        facts = facts.withColumn(n, make())
    return facts


def letters_of(made: DataFrame) -> DataFrame:
    """Undecodable input with its reason; empty probes are not kept, and secrets are cut from path and query."""
    rows = made.where("tag = 'letter'").select("tenant_id", "received_ms", "intake", "path", "query", "letter.*")
    secret = "|".join(SECRET_PARAMS)
    path = F.regexp_replace("path", f"(?i)((?:{secret})=)[^&]*", "$1-")
    query = F.map_filter("query", lambda k, _: ~F.lower(k).isin(*SECRET_PARAMS))
    return rows.where(~F.trim("body").isin(*PROBES)).select("tenant_id", "received_ms", "intake", "reason", path.alias("path"), query.alias("query"), "body", F.octet_length("body").alias("body_bytes"), "note")


def leftovers_of(made: DataFrame) -> DataFrame:
    """(tenant_id, received_ms, intake, extra): the keys of a body, or of an object without items, that belong to no item."""
    return made.where("tag = 'rest'").select("tenant_id", "received_ms", "intake", F.col("rest").alias("extra"))


def normalise(landing: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(facts, dead letters), each a plan of one scan; to have both, and the leftovers, from one, write ``outcomes`` first."""
    items, names = told(landing, spec, items_only=True)
    facts = items.where("tag = 'fact'").select("tenant_id", "received_ms", *[F.col(f"x_{n}").alias(n) for n in names])
    return _derived(facts, spec), letters_of(told(landing, spec)[0])


def leftovers(landing: DataFrame, spec: Spec, beside: tuple[str, ...] = ()) -> DataFrame:
    pairs = _opened(landing, spec, beside, rest_only=True)[0].where("rest is not null")
    return pairs.select("tenant_id", "received_ms", "intake", last_of(F.col("rest")).alias("extra"))


S, X, L, D, B, U = "string", "text", "bigint", "double", "boolean", "u64"
#: One spec for each signal. Paths after the type are tried in order.
SPECS: dict[str, Spec] = {
    "series_v2": Spec("series_v2", {"metric": (S, "$.metric"), "type_code": (L, "$.type"), "unit": (S, "$.unit"), "interval": (L, "$.interval"), "points": ("array<struct<timestamp:bigint,value:double>>", "$.points"), "resources": ("array<struct<name:string,type:string>>", "$.resources"), "source_type": (S, "$.source_type_name", "$.sourceTypeName"), "origin_product": (L, "$.metadata.origin.origin_product", "$.metadata.origin.originProduct"), "origin_category": (L, "$.metadata.origin.origin_category", "$.metadata.origin.originCategory"), "origin_service": (L, "$.metadata.origin.origin_service", "$.metadata.origin.originService")}, "$.series", required=("metric",), tags="$.tags"),
    "series_v1": Spec("series_v1", {"metric": (S, "$.metric"), "type": (S, "$.type"), "host": (S, "$.host"), "device": (S, "$.device"), "interval": (L, "$.interval"), "source_type": (S, "$.source_type_name"), "unit": (S, "$.unit"), "points": ("array<string>", "$.points")}, "$.series", required=("metric",), tags="$.tags"),
    "sketches": Spec("sketches", {"metric": (S, "$.metric"), "host": (S, "$.host"), "points": ("array<struct<ts:bigint,cnt:bigint,min:double,max:double,avg:double,sum:double,k:array<int>,n:array<bigint>>>", "$.dogsketches")}, "$.sketches", required=("metric",), tags="$.tags"),
    "distribution_points": Spec("distribution_points", {"metric": (S, "$.metric"), "host": (S, "$.host"), "points": ("array<struct<ts:bigint,values:array<double>>>", "$.points")}, "$.series", required=("metric",), tags="$.tags"),
    "check_runs": Spec("check_runs", {"check_name": (S, "$.check"), "host": (S, "$.host_name"), "status_code": (L, "$.status"), "message": (S, "$.message")}, required=("check_name",), tags="$.tags", times=(("$.timestamp", 1000, "sender"),)),
    "events": Spec("events", {"title": (S, "$.title"), "text": (S, "$.text"), "host": (S, "$.host"), "alert_type": (S, "$.alert_type"), "priority": (S, "$.priority")}, required=("title",), tags="$.tags", times=(("$.date_happened", 1000, "sender"),)),
    "logs": Spec("logs", {"message": (S, "$.message", "$.@m"), "host": (S, "$.hostname", "$.host"), "service": (S, "$.service", "$.dd_service"), "source": (S, "$.ddsource"), "status_sent": (S, "$.status"), "level": (S, "$.status", "$.@l"), "compact": (S, "$.@m")}, tags="$.ddtags",
        defaults={"source": "ddsource", "service": "service", "host": "hostname", "tags": "ddtags"}, times=(("$.timestamp", 1, "timestamp_ms"), ("$.timestamp", 0, "timestamp_string"), ("$.date", 1, "date_ms"), ("$.date", 0, "date_string"), ("$.@t", 0, "compact_string")),
        derive={"status": lambda: log_status()}, strict=("$.message", "$.hostname", "$.service", "$.ddsource", "$.ddtags")),
    "spans": Spec(
        "spans",
        {
            "trace_id": (U, "$.trace_id", "$.traceID"), "span_id": (U, "$.span_id", "$.spanID"), "parent_id": (U, "$.parent_id", "$.parentID"), "service": (S, "$.service"), "name": (S, "$.name"), "resource": (S, "$.resource"), "span_type": (S, "$.type"),
            "start": (L, "$.start"), "duration": (L, "$.duration"), "error": (L, "$.error"), "meta": ("map<string,string>", "$.meta"), "metrics": ("map<string,double>", "$.metrics"), "attributes": ("map<string,map<string,string>>", "$.attributes"),
            "links": ("array<struct<trace_id:decimal(20,0),trace_id_high:decimal(20,0),span_id:decimal(20,0),attributes:map<string,string>,tracestate:string,flags:bigint>>", "$.span_links", "$.spanLinks"),
            "span_events": ("array<struct<time_unix_nano:bigint,name:string,attributes:string>>", "$.span_events", "$.spanEvents"),
            "priority": (L, "$1.priority"), "origin": (S, "$1.origin"), "dropped_trace": (B, "$1.droppedTrace"), "chunk_tags": ("map<string,string>", "$1.tags"),
            "container_id": (S, "$2.containerID"), "language": (S, "$2.languageName"), "language_version": (S, "$2.languageVersion"), "tracer_version": (S, "$2.tracerVersion"), "runtime_id": (S, "$2.runtimeID"), "tracer_env": (S, "$2.env"),
            "tracer_hostname": (S, "$2.hostname"), "app_version": (S, "$2.appVersion"), "tracer_tags": ("map<string,string>", "$2.tags"),
        },
        "$.tracerPayloads", {"env": (S, "$.env"), "host": (S, "$.hostName"), "agent_version": (S, "$.agentVersion")}, ("trace_id", "span_id"), levels=("chunks", "spans"),
    ),
    "indexed_spans": Spec(
        "indexed_spans",
        {
            "strings": ("array<string>", "$2.strings"), "service_ref": (L, "$.serviceRef"), "name_ref": (L, "$.nameRef"), "resource_ref": (L, "$.resourceRef"), "type_ref": (L, "$.typeRef"), "env_ref": (L, "$.envRef"), "version_ref": (L, "$.versionRef"), "component_ref": (L, "$.componentRef"),
            "span_id": (U, "$.spanID"), "parent_id": (U, "$.parentID"), "start": (L, "$.start"), "duration": (L, "$.duration"), "error": (B, "$.error"), "kind_code": (L, "$.kind"), "attributes": ("map<string,variant>", "$.attributes"),
            "links": ("array<struct<traceID:string,spanID:decimal(20,0),attributes:map<string,variant>,tracestateRef:bigint,flags:bigint>>", "$.links"), "span_events": ("array<struct<time:bigint,nameRef:bigint,attributes:map<string,variant>>>", "$.events"),
            "trace": (S, "$1.traceID"), "priority": (L, "$1.priority"), "origin_ref": (L, "$1.originRef"), "dropped_trace": (B, "$1.droppedTrace"), "chunk_attributes": ("map<string,variant>", "$1.attributes"),
            "container_id_ref": (L, "$2.containerIDRef"), "language_ref": (L, "$2.languageNameRef"), "language_version_ref": (L, "$2.languageVersionRef"), "tracer_version_ref": (L, "$2.tracerVersionRef"), "runtime_id_ref": (L, "$2.runtimeIDRef"), "tracer_env_ref": (L, "$2.envRef"),
            "tracer_hostname_ref": (L, "$2.hostnameRef"), "app_version_ref": (L, "$2.appVersionRef"), "tracer_attributes": ("map<string,variant>", "$2.attributes"),
        },
        "$.idxTracerPayloads", {"env": (S, "$.env"), "host": (S, "$.hostName"), "agent_version": (S, "$.agentVersion")}, ("span_id",), levels=("chunks", "spans"),
    ),
    "trace_stats": Spec(
        "trace_stats",
        {
            "service": (S, "$.Service"), "name": (S, "$.Name"), "resource": (S, "$.Resource"), "http_status_code": (L, "$.HTTPStatusCode"), "span_type": (S, "$.Type"), "db_type": (S, "$.DBType"), "hits": (L, "$.Hits"), "errors": (L, "$.Errors"), "duration_ns": (L, "$.Duration"),
            "top_level_hits": (L, "$.TopLevelHits"), "synthetics": (B, "$.Synthetics"), "span_kind": (S, "$.SpanKind"), "peer_tags": ("array<string>", "$.PeerTags"), "is_trace_root": (L, "$.IsTraceRoot"), "ok_summary": ("variant", "$.OkSummary"), "error_summary": ("variant", "$.ErrorSummary"),
            "bucket_start": (L, "$1.Start"), "bucket_duration_ns": (L, "$1.Duration"), "agent_time_shift_ns": (L, "$1.AgentTimeShift"),
            "client_hostname": (S, "$2.Hostname"), "client_env": (S, "$2.Env"), "client_version": (S, "$2.Version"), "client_lang": (S, "$2.Lang"), "client_tracer_version": (S, "$2.TracerVersion"), "client_runtime_id": (S, "$2.RuntimeID"), "client_sequence": (L, "$2.Sequence"),
            "client_service": (S, "$2.Service"), "client_container_id": (S, "$2.ContainerID"), "client_tags": ("array<string>", "$2.Tags"),
        },
        "$.Stats", {"agent_hostname": (S, "$.AgentHostname"), "agent_env": (S, "$.AgentEnv"), "agent_version": (S, "$.AgentVersion"), "client_computed": (B, "$.ClientComputed"), "split_payload": (B, "$.SplitPayload")}, ("service",), levels=("Stats", "Stats"),
    ),
    "apm_stats": Spec("apm_stats", {"service": (S, "$.Service"), "resource": (S, "$.Resource"), "hits": (L, "$.Hits"), "errors": (L, "$.Errors"), "duration_ns": (L, "$.Duration")}, "$.Stats", {"bucket_start": (L, "$.Start"), "bucket_duration_ns": (L, "$.Duration")}, ("service",)),
    "processes": Spec("processes", {"pid": (L, "$.pid"), "command": (S, "$.command.exe"), "user": (S, "$.user.name"), "parent_pid": (L, "$.command.ppid"), "args": ("array<string>", "$.command.args"), "cwd": (S, "$.command.cwd"), "uid": (L, "$.user.uid"), "created": (L, "$.createTime"), "state": (S, "$.state"), "container_id": (S, "$.containerId"), "cpu": (D, "$.cpu.totalPct"), "user_cpu": (D, "$.cpu.userPct"), "system_cpu": (D, "$.cpu.systemPct"), "threads": (L, "$.cpu.numThreads"), "rss": (L, "$.memory.rss"), "vms": (L, "$.memory.vms"), "open_files": (L, "$.openFdCount"), "read_rate": (D, "$.ioStat.readRate"), "write_rate": (D, "$.ioStat.writeRate")}, "$.processes", {"host": (S, "$.hostName"), "group_id": (L, "$.groupId"), "group_size": (L, "$.groupSize")}, ("pid",)),
    "containers": Spec("containers", {"container_id": (S, "$.id"), "image": (S, "$.image"), "cpu": (D, "$.cpu"), "rss": (L, "$.memRss"), "state": (S, "$.state")}, "$.containers", {"host": (S, "$.hostName")}, ("container_id",), tags="$.tags"),
    "connections": Spec("connections", {"pid": (L, "$.pid"), "src": (S, "$.laddr.ip"), "dst": (S, "$.raddr.ip"), "port": (L, "$.raddr.port"), "bytes_sent": (L, "$.lastBytesSent")}, "$.connections", {"host": (S, "$.hostName")}, ("pid",)),
    "k8s_resources": Spec("k8s_resources", {"namespace": (S, "$.metadata.namespace"), "name": (S, "$.metadata.name"), "uid": (S, "$.metadata.uid"), "resource_version": (S, "$.metadata.resourceVersion"), "phase": (S, "$.status.phase"), "desired": (L, "$.spec.replicas", "$.replicasDesired"), "ready": (L, "$.status.readyReplicas"), "labels": ("map<string,string>", "$.metadata.labels"), "annotations": ("map<string,string>", "$.metadata.annotations"), "owners": ("array<struct<kind:string,name:string,uid:string>>", "$.metadata.ownerReferences"), "conditions": ("array<struct<type:string,status:string,reason:string,message:string,lastTransitionTime:string>>", "$.status.conditions"), "available": (L, "$.status.availableReplicas"), "updated": (L, "$.status.updatedReplicas"), "node": (S, "$.spec.nodeName"), "qos": (S, "$.status.qosClass"), "capacity": ("map<string,string>", "$.status.capacity"), "containers": ("array<struct<ready:boolean,restarts:bigint>>", "$.status.containers")}, "$.items", {"kind": (S, "$.kind"), "cluster_id": (S, "$.clusterId")}, ("name",)),
    "k8s_manifests": Spec("k8s_manifests", {"uid": (S, "$.uid"), "kind": (S, "$.kind", "$.content.kind"), "version": (S, "$.resourceVersion"), "content": (X, "$.content")}, "$.manifests", {"cluster_id": (S, "$.clusterId")}, ("uid",)),
    "k8s_objects": Spec(
        "k8s_objects",
        {
            "object": ("variant", "$"), "namespace": (S, "$.metadata.namespace"), "name": (S, "$.metadata.name"), "uid": (S, "$.metadata.uid"), "resource_version": (S, "$.metadata.resourceVersion"), "owners": ("array<struct<kind:string,name:string,uid:string>>", "$.metadata.ownerReferences"),
            "labels": ("array<string>", "$.metadata.labels"), "annotations": ("array<string>", "$.metadata.annotations"), "created_s": (L, "$.metadata.creationTimestamp"), "deleted_s": (L, "$.metadata.deletionTimestamp"),
            "conditions": ("array<struct<type:string,status:string,reason:string,message:string,lastTransitionTime:bigint,lastUpdateTime:bigint,lastProbeTime:bigint>>", "$.conditions"), "condition_message": (S, "$.conditionMessage"),
        },
        "$.objects", {"kind": (S, "$.kind"), "cluster_id": (S, "$.clusterId"), "cluster_name": (S, "$.clusterName"), "group_id": (L, "$.groupId"), "group_size": (L, "$.groupSize"), "envelope_tags": ("array<string>", "$.tags")}, ("kind", "uid"), tags="$.tags",
    ),
    "container_events": Spec("container_events", {"container_id": (S, "$.containerID"), "exit_code": (L, "$.exitCode"), "exited_at": (L, "$.exitTimestamp")}, "$.events", {"host": (S, "$.host"), "event_type": (S, "$.eventType")}, ("container_id",)),
    "container_images": Spec("container_images", {"digest": (S, "$.digest", "$.id"), "name": (S, "$.name"), "size": (L, "$.size"), "layers": ("array<struct<size:bigint>>", "$.layers")}, "$.images", required=("digest",), tags="$.tags"),
    "dbm_events": Spec("dbm_events", {"host": (S, "$.host"), "track": (S, "$.ddsource"), "statement": (S, "$.db.statement"), "plan": (S, "$.db.plan.definition"), "signature": (S, "$.db.query_signature")}, tags="$.ddtags", times=(("$.timestamp", 1, "sender"),)),
    "ndm_devices": Spec("ndm_devices", {"device_id": (S, "$.id"), "ip": (S, "$.ip_address"), "vendor": (S, "$.vendor"), "status": (L, "$.status")}, "$.devices", {"namespace": (S, "$.namespace")}, ("device_id",), tags="$.tags"),
    "ndm_interfaces": Spec("ndm_interfaces", {"device_id": (S, "$.device_id"), "index": (L, "$.index"), "name": (S, "$.name")}, "$.interfaces", {"namespace": (S, "$.namespace")}, ("device_id",)),
    "snmp_traps": Spec("snmp_traps", {"oid": (S, "$.trap.snmpTrapOID"), "uptime": (L, "$.trap.uptime"), "variables": ("array<map<string,string>>", "$.trap.variables")}, tags="$.trap.ddtags", times=(("$.trap.timestamp", 1, "sender"),)),
    "netflow": Spec("netflow", {"src": (S, "$.source.ip"), "dst": (S, "$.destination.ip"), "bytes": (L, "$.bytes"), "packets": (L, "$.packets"), "protocol": (S, "$.ip_protocol")}, times=(("$.flush_timestamp", 1, "sender"),)),
    "network_paths": Spec("network_paths", {"origin": (S, "$.source.hostname"), "target": (S, "$.destination.hostname"), "hops": ("array<struct<ttl:bigint,ip_address:string,rtt:double>>", "$.hops")}, times=(("$.timestamp", 1, "sender"),)),
    "rum": Spec("rum", {"kind": (S, "$.type"), "view_id": (S, "$.view.id"), "session_id": (S, "$.session.id"), "document_version": (L, "$._dd.document_version"), "name": (S, "$.action.name", "$.action.target.name", "$.resource.url", "$.error.message"), "loading_time": (L, "$.view.loading_time", "$.view.performance.loading_time")}, times=(("$.date", 1, "sender"),)),
    "security_events": Spec("security_events", {"rule": (S, "$.agent.rule_id"), "category": (S, "$.evt.category"), "process": (S, "$.process.executable.path")}, tags="$.ddtags", times=(("$.timestamp", 1, "sender"),)),
    "sbom": Spec("sbom", {"entity": (S, "$.id"), "kind": (S, "$.type"), "in_use": (B, "$.inUse"), "status": (S, "$.status"), "error": (S, "$.error"), "bom": (X, "$.cyclonedx")}, "$.entities", {"host": (S, "$.host"), "source": (S, "$.source"), "env": (S, "$.ddEnv")}, ("entity",)),
    "sds": Spec("sds", {"rule": (S, "$.rule"), "resource": (S, "$.resource"), "matches": (L, "$.matches"), "failed": (B, "$.failed"), "found": ("array<struct<path:string,start:bigint,end:bigint,confidence:string>>", "$.matchDetails")}, "$.results", {"scan_id": (S, "$.scanId")}),
    "synthetics": Spec("synthetics", {"test_id": (S, "$.testId"), "location": (S, "$.location"), "passed": (B, "$.passed"), "duration": (D, "$.duration")}, "$.results", required=("test_id",)),
    "telemetry": Spec("telemetry", {"name": (S, "$.name"), "value": (X, "$.value"), "origin": (S, "$.origin")}, "$.payload.configuration", {"service": (S, "$.application.service_name"), "request_type": (S, "$.request_type")}, ("name",)),
    "ci_tests": Spec("ci_tests", {"kind": (S, "$.type"), "test": (S, "$.content.meta.test\\.name", "$.content.resource"), "suite": (S, "$.content.meta.suite", "$.content.service"), "status": (S, "$.content.meta.status"), "start": (L, "$.content.start"), "duration": (L, "$.content.duration")}, "$.events", {"env": (S, "$.metadata.env"), "runtime": (S, "$.metadata.runtime")}),
    "ci_webhooks": Spec("ci_webhooks", {"delivery": (S, "$.delivery"), "action": (S, "$.action"), "repository": (S, "$.repository.full_name", "$.project.path")}, required=("delivery",)),
    "git_commits": Spec("git_commits", {"sha": (S, "$.id")}, "$.data", {"repository": (S, "$.meta.repository_url")}, ("sha",)),
    "hosts": Spec("hosts", {"host": (S, "$.internalHostname"), "os": (S, "$.os"), "agent_version": (S, "$.agentVersion"), "platform": (S, "$.systemStats.platform"), "python": (S, "$.systemStats.pythonV")}, required=("host",)),
    "agent_metadata": Spec("agent_metadata", {"host": (S, "$.hostname"), "uuid": (S, "$.uuid"), "payload": ("map<string,string>", "$.agent_metadata", "$.host_metadata", "$.check_metadata")}, required=("host",)),
    "debugger_logs": Spec("debugger_logs", {"service": (S, "$.service"), "probe_id": (S, "$.debugger.snapshot.probe.id"), "message": (S, "$.message")}, tags="$.ddtags", times=(("$.timestamp", 1, "sender"),)),
    "profiles_meta": Spec("profiles_meta", {"family": (S, "$.family"), "start": (S, "$.start"), "end": (S, "$.end"), "attachments": ("array<string>", "$.attachments")}, tags="$.tags_profiler"),
}
SPECS |= {
    "intake_events": Spec("intake_events", {"title": (S, "$.msg_title"), "text": (S, "$.msg_text"), "host": (S, "$.host"), "alert_type": (S, "$.alert_type")}, "$.events", {"agent_host": (S, "$.internalHostname")}, keyed="source", tags="$.tags", times=(("$.timestamp", 1000, "sender"),)),
    "agent_checks": Spec("agent_checks", {"name": (X, "$[0]"), "source": (X, "$[1]"), "instance": (X, "$[2]"), "status": (X, "$[3]"), "message": (X, "$[4]")}, "$.agent_checks", {"host": (S, "$.internalHostname")}, ("name",)),
    "external_host_tags": Spec("external_host_tags", {"host": (S, "$[0]"), "by_source": ("map<string,array<string>>", "$[1]")}, "$.external_host_tags", required=("host",)),
    "process_groups": Spec("process_groups", {"user": (S, "$[0]"), "cpu": (D, "$[1]"), "mem": (D, "$[2]"), "name": (S, "$[5]"), "pids": (L, "$[6]")}, "$.processes", {"host": (S, "$.internalHostname")}),
    "pipeline_points": Spec("pipeline_points", {"hash": (L, "$.Hash"), "parent_hash": (L, "$.ParentHash"), "edge_tags": ("array<string>", "$.EdgeTags"), "bucket_start": (L, "$1.Start")}, "$.Stats", {"service": (S, "$.Service"), "env": (S, "$.Env")}, levels=("Stats",)),
    "pipeline_backlogs": Spec("pipeline_backlogs", {"value": (L, "$.Value"), "backlog_tags": ("array<string>", "$.Tags"), "bucket_start": (L, "$1.Start")}, "$.Stats", {"service": (S, "$.Service")}, levels=("Backlogs",)),
    "dsm_messages": Spec("dsm_messages", {"topic": (S, "$.topic"), "partition": (L, "$.partition"), "offset": (L, "$.offset"), "text": (S, "$.message")}),
    "process_stats": Spec("process_stats", {"pid": (L, "$.pid"), "cpu": (D, "$.cpu.totalPct"), "rss": (L, "$.memory.rss"), "threads": (L, "$.threads")}, "$.stats", {"host": (S, "$.hostName")}, ("pid",)),
    "discoveries": Spec("discoveries", {"pid": (L, "$.pid"), "command": (S, "$.command.exe"), "user": (S, "$.user.name")}, "$.processDiscoveries", {"host": (S, "$.hostName"), "group_size": (L, "$.groupSize")}, ("pid",)),
    "snapshots": Spec("snapshots", {"host": (S, "$.hostName"), "kind": (S, "$.kind"), "group_id": (L, "$.groupId"), "group_size": (L, "$.groupSize"), "agent_version": (S, "$.agentVersion")}, required=("host",)),
    "container_stats": Spec("container_stats", {"container_id": (S, "$.id"), "cpu": (D, "$.totalPct"), "rss": (L, "$.memRss"), "limit": (L, "$.memLimit")}, "$.containerStats", {"host": (S, "$.hostName"), "source": (S, "$.source")}, ("container_id",)),
    "connections_payload": Spec("connections_payload", {"pid": (L, "$.pid"), "tag_indexes": ("array<int>", "$.tags")}, "$.connections", {"host": (S, "$.hostName"), "pool": ("array<string>", "$.tagsPool")}, ("pid",)),
    "usm_http": Spec("usm_http", {"pid": (L, "$1.pid"), "path": (S, "$.path"), "method": (S, "$.method"), "by_status": ("map<string,struct<count:bigint>>", "$.statsByStatusCode")}, "$.connections", {"host": (S, "$.hostName")}, levels=("httpAggregations",)),
    "usm_kafka": Spec("usm_kafka", {"pid": (L, "$1.pid"), "topic": (S, "$.topic"), "by_error": ("map<string,struct<count:bigint>>", "$.statsByErrorCode")}, "$.connections", {"host": (S, "$.hostName")}, levels=("kafkaAggregations",)),
    "usm_db": Spec("usm_db", {"pid": (L, "$1.pid"), "table_name": (S, "$.tableName"), "operation": (S, "$.operation"), "count": (L, "$.count")}, "$.connections", {"host": (S, "$.hostName")}, levels=("dbAggregations",)),
    "k8s_cluster": Spec("k8s_cluster", {"cluster_id": (S, "$.clusterId"), "nodes": (L, "$.cluster.nodeCount"), "versions": ("map<string,bigint>", "$.cluster.kubeletVersions"), "cpu": (L, "$.cluster.cpuAllocatable")}, required=("cluster_id",)),
    "k8s_actions": Spec("k8s_actions", {"action_id": (S, "$.actionId"), "kind": (S, "$.resource.kind"), "name": (S, "$.resource.name"), "status": (S, "$.status")}, "$.results", required=("action_id",)),
    "ecs_tasks": Spec("ecs_tasks", {"arn": (S, "$.arn"), "family": (S, "$.family"), "status": (S, "$.lastStatus", "$.knownStatus"), "containers": ("array<struct<name:string>>", "$.containers")}, "$.tasks", {"cluster": (S, "$.clusterName")}, ("arn",), tags="$.tags"),
    "ndm_ips": Spec("ndm_ips", {"interface": (S, "$.interface_id"), "ip": (S, "$.ip_address"), "prefix": (L, "$.prefixlen")}, "$.ip_addresses", {"namespace": (S, "$.namespace")}),
    "ndm_objects": Spec("ndm_objects", {"device_id": (S, "$.device_id"), "kind": (S, "$.type"), "name": (S, "$.name")}, "$.objects", {"namespace": (S, "$.namespace")}),
    "ndm_configs": Spec("ndm_configs", {"device_id": (S, "$.device_id"), "kind": (S, "$.config_type"), "content": (S, "$.config_content")}, "$.configs", {"namespace": (S, "$.namespace")}, ("device_id",), tags="$.tags", times=(("$.timestamp", 1000, "sender"),)),
    "rum_timeseries": Spec("rum_timeseries", {"kind": (S, "$.type"), "view_id": (S, "$.view.id"), "name": (S, "$.timeseries.name"), "samples": ("array<struct<timestamp:bigint,value:double>>", "$.timeseries.data")}, times=(("$.date", 1, "sender"),)),
    "rum_spans": Spec("rum_spans", {"trace_id": (S, "$.trace_id"), "span_id": (S, "$.span_id"), "name": (S, "$.name"), "view_id": (S, "$.meta._dd\\.view\\.id", "$.meta.view_id"), "duration": (L, "$.duration")}, "$.spans", {"env": (S, "$.env")}, ("span_id",)),
    "rum_replay": Spec("rum_replay", {"view_id": (S, "$.view.id"), "session_id": (S, "$.session.id"), "start": (L, "$.start"), "end": (L, "$.end"), "records": (L, "$.records_count")}),
    "discovery": Spec("discovery", {"service": (S, "$.payload.service_name"), "host": (S, "$.payload.host_name"), "pid": (L, "$.payload.pid"), "ports": ("array<bigint>", "$.payload.ports"), "kind": (S, "$.request_type")}),
    "health": Spec("health", {"host": (S, "$.host"), "check": (S, "$.issue.id", "$.check"), "state": (S, "$.issue.state", "$.status")}, "$.events"),
    "event_mgmt": Spec("event_mgmt", {"title": (S, "$.attributes.title"), "category": (S, "$.attributes.category"), "key": (S, "$.attributes.aggregation_key")}, "$.data", tags="$.attributes.tags", times=(("$.attributes.timestamp", 1, "sender"),)),
    "software": Spec("software", {"name": (S, "$.name"), "version": (S, "$.version"), "publisher": (S, "$.publisher")}, "$.software", {"host": (S, "$.hostname")}, ("name",)),
    "lineage": Spec("lineage", {"job": (S, "$.job.name"), "run": (S, "$.run.runId"), "state": (S, "$.eventType"), "inputs": ("array<struct<name:string>>", "$.inputs"), "outputs": ("array<struct<name:string>>", "$.outputs")}, times=(("$.eventTimeMs", 1, "sender"),)),
    "ci_coverage": Spec("ci_coverage", {"session": (S, "$.test_session_id"), "suite": (S, "$.test_suite_id"), "files": ("array<struct<filename:string>>", "$.files")}, "$.coverages"),
    "ci_pipeline": Spec("ci_pipeline", {"pipeline": (S, "$.attributes.resource.name"), "level": (S, "$.attributes.resource.level"), "status": (S, "$.attributes.resource.status"), "start": (S, "$.attributes.resource.start")}, "$.data"),
    "ci_settings": Spec("ci_settings", {"service": (S, "$.request.service"), "repository": (S, "$.request.repository_url"), "skipping": (B, "$.response.tests_skipping")}),
    "batch_metadata": Spec("batch_metadata", {"sender": (S, "$.metadata.sender"), "version": (S, "$.metadata.version"), "series": ("array<string>", "$.series")}),
    "query_actions": Spec("query_actions", {"action": (S, "$.action"), "result": ("map<string,string>", "$.result")}),
    "symbol_queries": Spec("symbol_queries", {"build_id": (S, "$")}, "$.data.buildIds", {"arch": (S, "$.data.arch")}),
    "debugger_diagnostics": Spec("debugger_diagnostics", {"probe_id": (S, "$.debugger.diagnostics.probeId"), "status": (S, "$.debugger.diagnostics.status"), "service": (S, "$.service")}, times=(("$.timestamp", 1, "sender"),)),
    "symdb": Spec("symdb", {"service": (S, "$.service"), "language": (S, "$.language"), "scopes": ("array<string>", "$.scopes")}),
    "ci_test_events": Spec(
        "ci_test_events",
        {
            "event_type": (S, "$.type"), "event_version": (L, "$.version"), "session_id": (U, "$.content.test_session_id"), "module_id": (U, "$.content.test_module_id"), "suite_id": (U, "$.content.test_suite_id"), "trace_id": (U, "$.content.trace_id"), "span_id": (U, "$.content.span_id"),
            "service": (S, "$.content.service"), "resource": (S, "$.content.resource"), "start": (L, "$.content.start"), "duration": (L, "$.content.duration"), "error": (L, "$.content.error"), "meta": ("map<string,string>", "$.content.meta"), "metrics": ("map<string,double>", "$.content.metrics"),
        },
        "$.events", {"payload_version": (L, "$.version"), "metadata": ("map<string,map<string,string>>", "$.metadata")}, ("event_type",),
    ),
    "telemetry_requests": Spec(
        "telemetry_requests",
        {
            "request_type": (S, "$.request_type"), "api_version": (S, "$.api_version"), "runtime_id": (S, "$.runtime_id"), "seq_id": (L, "$.seq_id"), "tracer_time": (L, "$.tracer_time"), "service_name": (S, "$.application.service_name"), "service_version": (S, "$.application.service_version"),
            "env": (S, "$.application.env"), "language_name": (S, "$.application.language_name"), "tracer_version": (S, "$.application.tracer_version"), "hostname": (S, "$.host.hostname"), "payload": ("variant", "$.payload"),
        },
        required=("request_type",),
    ),
    "cws_dump": Spec("cws_dump", {"container": (S, "$.metadata.container_id"), "tree": (X, "$.tree")}),
}
CONTAINER = {
    "container_id": (S, "{0}.id"), "name": (S, "{0}.name"), "image": (S, "{0}.image"), "type": (S, "{0}.type"), "repo_digest": (S, "{0}.repoDigest"), "cpu_limit": (D, "{0}.cpuLimit"), "memory_limit": (L, "{0}.memoryLimit"), "state": (X, "{0}.state"), "health": (X, "{0}.health"), "created_s": (L, "{0}.created"), "started_s": (L, "{0}.started"),
    "user_cpu": (D, "{0}.userPct"), "system_cpu": (D, "{0}.systemPct"), "cpu": (D, "{0}.totalPct"), "rss": (L, "{0}.memRss"), "cache": (L, "{0}.memCache"), "threads": (L, "{0}.threadCount"), "addresses": ("array<struct<ip:string,port:bigint,protocol:string>>", "{0}.addresses"),
}
CONTAINER_FRAME = {"host": (S, "$.hostName"), "network_id": (S, "$.networkId"), "group_id": (L, "$.groupId"), "group_size": (L, "$.groupSize")}
STATS_FRAME = {"host": (S, "$.hostName"), "host_id": (L, "$.hostId"), "cpus": (L, "$.numCpus"), "total_memory": (L, "$.totalMemory")}


def _inside(path: str) -> dict[str, tuple[str, ...]]:
    return {n: (kind, *[p.format(path) for p in ps]) for n, (kind, *ps) in CONTAINER.items()}


#: The messages in which containers and their statistics come: the source's name, and how its list is read.
CONTAINER_MESSAGES = {
    "collector_container": Spec("collector_container", _inside("$"), "$.containers", CONTAINER_FRAME, ("container_id",), tags="$.tags"),
    "collector_proc": Spec("collector_proc", _inside("$"), "$.containers", CONTAINER_FRAME, ("container_id",), tags="$.tags"),
    "process": Spec("collector_proc", {"pid": (L, "$.pid"), **_inside("$.container")}, "$.processes", CONTAINER_FRAME, tags="$.container.tags"),
}
STAT_MESSAGES = {
    "collector_realtime": Spec("collector_realtime", _inside("$"), "$.containerStats", STATS_FRAME | {"org_id": (L, "$.orgId")}, ("container_id",)),
    "collector_container_realtime": Spec("collector_container_realtime", _inside("$"), "$.stats", STATS_FRAME, ("container_id",)),
}
METRIC_TYPES = ("UNSPECIFIED", "COUNT", "RATE", "GAUGE")
CHECK_STATUS = ("OK", "WARNING", "CRITICAL", "UNKNOWN")
#: Levels of the compact form that go by another name.
LEVELS = {"trace": "debug", "verbose": "debug", "information": "info", "warning": "warn", "fatal": "critical"}


def named(code: Column, names: tuple[str, ...]) -> Column:
    """A number's name; an unknown number as text."""
    known = F.get(F.array(*map(F.lit, names)), F.when(code.between(0, len(names) - 1), code.cast("int")))
    return F.coalesce(known, code.cast("string"))


def log_status() -> Column:
    """The status as sent; else the compact level under its usual name, which a compact message without one leaves at info; else empty."""
    level = F.lower("level")
    named_level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level), level)
    return F.coalesce("status_sent", named_level, F.when(F.col("compact").eqNullSafe(F.col("message")), "info").otherwise(""))


def metric_rows(series: DataFrame, version: int = 2) -> DataFrame:
    """A row for each point of normalised series; host and device from where the version keeps them."""
    if version == 2:
        is_host = lambda r: r["type"] == "host"
        host = F.get(F.filter("resources", is_host), 0)["name"]
        rest = F.map_from_entries(F.transform(F.filter("resources", lambda r: ~is_host(r)), lambda r: F.struct(r["type"], r["name"])))
        return series.withColumn("p", F.explode("points")).select(
            "tenant_id", "metric", (F.col("p.timestamp") * 1000).alias("t_ms"), F.col("p.value").alias("value"), named(F.col("type_code"), METRIC_TYPES).alias("metric_type"),
            F.coalesce(F.col("interval"), F.lit(0)).alias("interval"), F.coalesce(host, F.lit("")).alias("host"), rest.alias("resources"), "tags", "unit", "source_type", "origin_product", "origin_category", "origin_service", "extra", "note",
        )
    word = F.upper("type")
    rows = series.withColumn("raw", F.explode("points")).withColumn("p", F.from_json("raw", "array<double>")).where(pair_of_numbers())
    resources = F.when(F.coalesce("device", F.lit("")) != "", F.create_map(F.lit("device"), F.col("device"))).otherwise(F.create_map().cast(TEXTS))
    return rows.select(
        "tenant_id", "metric", (F.col("p")[0].cast("long") * 1000).alias("t_ms"), F.col("p")[1].alias("value"), F.when(word.isin(*METRIC_TYPES), word).otherwise("UNSPECIFIED").alias("metric_type"),
        F.coalesce("interval", F.lit(0)).alias("interval"), F.coalesce("host", F.lit("")).alias("host"), resources.alias("resources"), "source_type", "unit", "tags", "extra", "note",
    )


def pair_of_numbers() -> Column:
    return F.coalesce(F.get("p", F.lit(0)).isNotNull() & F.get("p", F.lit(1)).isNotNull(), F.lit(False))


def bad_pairs(series: DataFrame) -> DataFrame:
    """Dead letters for the points of version 1 that are no [timestamp, value] pair of numbers; a series is kept through its other points."""
    rows = series.select("tenant_id", "received_ms", "metric", F.posexplode("points").alias("at", "raw")).withColumn("p", F.from_json("raw", "array<double>"))
    note = F.concat(F.lit("points["), F.col("at").cast("string"), F.lit("]: expected a [timestamp, value] pair of numbers"))
    return rows.where(~pair_of_numbers()).select("tenant_id", "received_ms", F.lit("series_v1").alias("intake"), F.lit("unexpected_shape").alias("reason"), "metric", F.col("raw").alias("body"), note.alias("note"))


def distribution_rows(series: DataFrame) -> DataFrame:
    """A sketch for each point's values: (tenant_id, metric, host, tags, t_ms, bucket_keys, bucket_counts, count, min, max, avg, sum)."""
    values = F.filter("p.values", lambda v: v.isNotNull())
    rows = series.withColumn("p", F.explode("points")).withColumn("v", values).withColumn("k", F.array_sort(F.transform("v", sketch_key))).where(F.size("v") > 0)
    keys = F.array_distinct("k")
    total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        "tenant_id", "metric", F.coalesce("host", F.lit("")).alias("host"), "tags", (F.col("p.ts") * 1000).alias("t_ms"), keys.alias("bucket_keys"),
        F.transform(keys, lambda x: F.size(F.filter("k", lambda y: y == x)).cast("long")).alias("bucket_counts"), F.size("v").cast("long").alias("count"),
        F.array_min("v").alias("min"), F.array_max("v").alias("max"), (total / F.size("v")).alias("avg"), total.alias("sum"),
    )


def span_rows(spans: DataFrame) -> DataFrame:
    """Spans with both halves of the trace id, the kind, typed attributes put with meta and metrics, and links and events as aligned arrays."""
    signed = lambda c: F.when(c >= F.lit(str(1 << 63)).cast("decimal(20,0)"), c - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(c).cast("bigint")
    tid = F.try_element_at("meta", F.lit("_dd.p.tid"))
    high = F.when(tid.rlike("^[0-9A-Fa-f]{1,16}$"), signed(F.conv(tid, 16, 10).cast("decimal(20,0)"))).otherwise(F.lit(0).cast("bigint"))
    strings, numbers = split_attributes(F.col("attributes"))
    meta = last_of(F.concat(F.coalesce(F.map_entries("meta"), F.array().cast(PAIRS)), strings))
    pairs = "array<struct<key:string,value:double>>"
    metrics = last_of(F.concat(F.coalesce(F.map_entries("metrics"), F.array().cast(pairs)), numbers))
    each = lambda column, of: F.transform(F.coalesce(F.col(column), F.array()), of)
    return spans.withColumns(
        {
            "trace_id_high": high, "kind": F.coalesce(F.try_element_at("meta", F.lit("span.kind")), F.lit("")),
            "link_trace_id": each("links", lambda x: signed(x["trace_id"])), "link_trace_id_high": each("links", lambda x: signed(x["trace_id_high"])), "link_span_id": each("links", lambda x: signed(x["span_id"])),
            "link_attributes": each("links", lambda x: F.to_json(x["attributes"])), "link_tracestate": each("links", lambda x: x["tracestate"]), "link_flags": each("links", lambda x: x["flags"]),
            "event_time": each("span_events", lambda x: x["time_unix_nano"]), "event_name": each("span_events", lambda x: x["name"]), "event_attributes": each("span_events", lambda x: x["attributes"]),
        }
    ).withColumns({"meta": meta, "metrics": metrics}).drop("links", "span_events")


SPAN_KINDS = ("", "internal", "server", "client", "producer", "consumer")  # fixed values, by their codes


def _string_at(ref: Column) -> Column:
    """A reference into the payload's own table; zero and what lies outside are empty."""
    return F.when(ref > 0, F.coalesce(F.get("strings", ref.cast("int")), F.lit(""))).otherwise("")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _readable(value: Column) -> Column:
    """The JSON of a typed value with its references put in, at any depth: {"string": ...}, {"int": ...}, {"array": [...]}, {"kvlist": [{"key", "value"}]}.

    Such a value has no text of its own, only references, numbers and base64, so its JSON can be cut at the references.
    """
    plain = F.to_json(value)
    for wire, tag in (("boolValue", "bool"), ("intValue", "int"), ("doubleValue", "double"), ("bytesValue", "bytes")):
        plain = F.replace(plain, F.lit(f'"{wire}":'), F.lit(f'"{tag}":'))
    for wire, inner, tag in (("arrayValue", "values", "array"), ("keyValueList", "keyValues", "kvlist")):
        plain = F.replace(F.replace(plain, F.lit(f'"{wire}":{{}}'), F.lit(f'"{wire}":{{"{inner}":[]}}')), F.lit(f'"{wire}":{{"{inner}":['), F.lit(f'"{tag}":['))
    return let(F.replace(plain, F.lit("]}}"), F.lit("]}")), _put_in)


def _put_in(plain: Column) -> Column:
    """The text with what its references stand for; one without references as it is."""
    reference = r'("stringValueRef"|"key"):(\d+)'
    between = F.split(plain, reference, -1)
    names, refs = (F.regexp_extract_all(plain, F.lit(reference), F.lit(k)) for k in (1, 2))
    texts = F.zip_with(names, refs, lambda n, r: F.concat(F.when(n == '"key"', '"key":').otherwise('"string":'), _quoted(_string_at(r.try_cast("bigint")))))
    put = F.array_join(F.flatten(F.zip_with(between, texts, lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))), "")
    return F.when(plain.contains('"stringValueRef":') | plain.contains('"key":'), put).otherwise(plain)


def _by_reference(attributes: Column) -> Column:
    """(ref, key, value) in order of the references, so that of two with one name the higher comes last."""
    entries = F.transform(F.coalesce(F.map_entries(attributes), F.array().cast("array<struct<key:string,value:variant>>")), lambda e: F.struct(e["key"].try_cast("bigint").alias("ref"), e["value"].alias("value")))
    value = lambda all_of, r: F.get(F.filter(all_of, lambda e: e["ref"] == r), F.lit(0))["value"]
    return let(entries, lambda a: F.transform(F.array_sort(F.transform(a, lambda e: e["ref"])), lambda r: F.struct(_string_at(r).alias("key"), value(a, r).alias("value"))))


def _readable_attributes(attributes: Column) -> Column:
    named_values = last_of(F.transform(_by_reference(attributes), lambda e: F.struct(e["key"].alias("key"), F.coalesce(_readable(e["value"]), F.lit("null")).alias("value"))))
    each = F.transform(F.map_entries(named_values), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    return F.when(F.coalesce(F.size(attributes), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}")))


def _scalars(entries: Column, kinds: dict[str, str], of: str) -> Column:
    """Of (ref, key, value) those of these wire types as a map; ``of``: text, number or bytes."""

    def value(e: Column) -> Column:
        found = {k: F.try_variant_get(e["value"], f"$.{k}", t) for k, t in kinds.items()}
        texts = [let(v, lambda r: F.when(r.isNotNull(), _string_at(r))) if k == "stringValueRef" else v for k, v in found.items()]
        return F.coalesce(*[F.unbase64(t) if of == "bytes" else t.cast("double" if of == "number" else "string") for t in texts])

    made = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))), lambda e: e["value"].isNotNull())
    return last_of(made)


def indexed_span_rows(spans: DataFrame) -> DataFrame:
    """Spans whose texts are references into their payload's string table, as ``span_rows`` has those with texts: strings and flags to
    ``meta``, numbers to ``metrics``, bytes to ``meta_struct``; ``attributes_json`` keeps every value under its type, whole numbers exactly,
    nested ones at any depth. The table goes with every span until it is resolved here, and no further."""
    half = lambda c, k: F.when(F.length(F.unbase64(c)) == 16, F.conv(F.hex(F.substring(F.unbase64(c), 1 + 8 * k, 8)), 16, 10).cast("decimal(20,0)"))
    signed = lambda c: F.coalesce(F.when(c >= F.lit(str(1 << 63)).cast("decimal(20,0)"), c - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(c).cast("bigint"), F.lit(0).cast("bigint"))
    text, number = {"stringValueRef": "bigint", "boolValue": "boolean"}, {"intValue": "bigint", "doubleValue": "double"}
    refs = [c for c in spans.columns if c.endswith("_ref")]
    each = lambda column, of: F.transform(F.coalesce(F.col(column), F.array()), of)
    named_by = {c: f"by_reference_{c}" for c in ("attributes", "tracer_attributes", "chunk_attributes")}
    spans = spans.withColumns({n: _by_reference(F.col(c)) for c, n in named_by.items()})
    return spans.withColumns(
        {
            **{c.removesuffix("_ref"): _string_at(F.col(c)) for c in refs}, "trace_id_high": signed(half(F.col("trace"), 0)), "trace_id": signed(half(F.col("trace"), 1)),
            "kind": F.coalesce(F.get(F.array(*map(F.lit, SPAN_KINDS)), F.col("kind_code").cast("int")), F.lit("")), "error": F.coalesce(F.col("error").cast("long"), F.lit(0).cast("long")),
            "meta": _scalars(F.col(named_by["attributes"]), text, "text"), "metrics": _scalars(F.col(named_by["attributes"]), number, "number"), "meta_struct": _scalars(F.col(named_by["attributes"]), {"bytesValue": "string"}, "bytes"), "attributes_json": _readable_attributes(F.col("attributes")),
            "tracer_tags": _scalars(F.col(named_by["tracer_attributes"]), text | number, "text"), "chunk_tags": _scalars(F.col(named_by["chunk_attributes"]), text | number, "text"),
            "link_trace_id": each("links", lambda x: signed(half(x["traceID"], 1))), "link_trace_id_high": each("links", lambda x: signed(half(x["traceID"], 0))), "link_span_id": each("links", lambda x: signed(x["spanID"])),
            "link_attributes": each("links", lambda x: _readable_attributes(x["attributes"])), "link_tracestate": each("links", lambda x: _string_at(x["tracestateRef"])), "link_flags": each("links", lambda x: x["flags"]),
            "event_time": each("span_events", lambda x: x["time"]), "event_name": each("span_events", lambda x: _string_at(x["nameRef"])), "event_attributes": each("span_events", lambda x: _readable_attributes(x["attributes"])),
        }
    ).drop(*refs, "strings", "trace", "kind_code", "attributes", "tracer_attributes", "chunk_attributes", "links", "span_events", *named_by.values())


def split_attributes(attributes: Column) -> tuple[Column, Column]:
    """Attributes tagged by type ({"string": v}, {"int": n}...) -> pairs of texts and flags, and pairs of numbers."""
    entries = F.coalesce(F.map_entries(attributes), F.array().cast("array<struct<key:string,value:map<string,string>>>"))
    text = lambda e: F.coalesce(F.try_element_at(e["value"], F.lit("string")), F.try_element_at(e["value"], F.lit("bool")))
    number = lambda e: F.coalesce(F.try_element_at(e["value"], F.lit("int")), F.try_element_at(e["value"], F.lit("double"))).try_cast("double")
    pairs = lambda of: F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), of(e).alias("value"))), lambda e: e["value"].isNotNull())
    return pairs(text), pairs(number)


def sbom_components(entities: DataFrame) -> DataFrame:
    """(entity, bom_ref, parent_bom_ref, depth, name, version, purl): every component, at any depth, with the one it is part of."""
    nodes = flatten_tree(entities, "bom", ["entity"], "$.components", "$.bom-ref").where(F.size("path") > 1)
    at = lambda key: F.get_json_object("node", f"$.{key}")
    return nodes.select("entity", at("bom-ref").alias("bom_ref"), F.coalesce("parent", F.lit("")).alias("parent_bom_ref"), (F.size("path") - 2).alias("depth"), at("name").alias("name"), at("version").alias("version"), at("purl").alias("purl"))


def sbom_vulnerabilities(entities: DataFrame) -> DataFrame:
    """(entity, id, description, ratings, affects): a row for each vulnerability, with the references of what it affects."""
    kind = "array<struct<id:string,description:string,ratings:array<struct<score:double,severity:string>>,affects:array<struct<ref:string>>>>"
    rows = entities.select("entity", F.explode(F.from_json(F.get_json_object("bom", "$.vulnerabilities"), kind)).alias("v"))
    return rows.select("entity", F.col("v.id").alias("id"), F.col("v.description").alias("description"), F.col("v.ratings").alias("ratings"), F.col("v.affects.ref").alias("affects"))


def test_event_rows(events: DataFrame) -> DataFrame:
    """Test events with the batch's metadata put on each: what holds of all events, and over it what the batch says of the event's own type.

    env, runtime and test names come from the event's tags, else from that metadata; a flag or number that no tag has is null, not false."""
    merged = last_of(F.concat(*[F.coalesce(F.map_entries(F.try_element_at("metadata", k)), F.array().cast(PAIRS)) for k in (F.lit("*"), F.col("event_type"))]))
    rows = events.withColumn("metadata", merged)
    tag = lambda k: F.nullif(F.try_element_at("meta", F.lit(k)), F.lit(""))
    either = lambda k: F.coalesce(tag(k), F.try_element_at("metadata", F.lit(k)), F.lit(""))
    number = lambda k: F.coalesce(F.try_element_at("metrics", F.lit(k)).cast("long"), F.trim(tag(k)).try_cast("long"))
    flag = lambda k: F.when(tag(k).isNotNull(), F.lower(F.trim(tag(k))).isin("true", "1", "yes"))
    names = {"env": "env", "language": "language", "runtime": "runtime.name", "branch": "git.branch", "commit_sha": "git.commit.sha", "repository": "git.repository_url"}
    own = {"test_name": "test.name", "suite": "test.suite", "module": "test.module", "status": "test.status", "framework": "test.framework", "skip_reason": "test.skip_reason"}
    return rows.withColumns(
        {n: either(k) for n, k in names.items()} | {n: F.coalesce(tag(k), F.lit("")) for n, k in own.items()} | {"source_start": number("test.source.start"), "is_new": flag("test.is_new"), "is_retry": flag("test.is_retry")}
    )


def telemetry_rows(requests: DataFrame) -> DataFrame:
    """A row for each request, and for each message of a batch one more that has the request's columns, its place in the batch and the
    request's type as ``parent_request_type``. A batch whose payload is no list of objects stays one row."""
    batch = F.when(F.col("request_type") == "message-batch", listed(F.col("payload")))
    fit = F.forall(batch, lambda x: F.is_variant_null(x) | members(x).isNotNull())
    kept = [c for c in requests.columns if c not in ("request_type", "payload")]
    entry = lambda kind, payload, nth, parent: F.struct(kind.alias("request_type"), F.to_json(payload).alias("payload"), nth.cast("int").alias("batch_index"), parent.alias("parent_request_type"))
    own = F.array(entry(F.col("request_type"), F.col("payload"), F.lit(None), F.lit("")))
    each = F.transform(F.when(fit, batch), lambda x, i: entry(F.coalesce(there(x, "request_type").cast("string"), F.lit("")), there(x, "payload"), i, F.col("request_type")))
    return requests.select(*kept, F.inline(F.concat(own, F.coalesce(each, F.filter(own, lambda _: F.lit(False))))))


def scan_matches(results: DataFrame) -> DataFrame:
    """A row for each match of a scan's results: (scan_id, rule, resource, nth, path, start, end, confidence). Results that list none have none."""
    rows = results.select("tenant_id", "received_ms", "scan_id", "rule", "resource", F.posexplode("found").alias("nth", "m"))
    return rows.select("tenant_id", "received_ms", "scan_id", "rule", "resource", "nth", "m.path", "m.start", "m.end", "m.confidence")


def pod_counts(resources: DataFrame) -> DataFrame:
    """(name, ready_containers, containers, restarts) over each pod's container array."""
    count = lambda f: F.aggregate("containers", F.lit(0).cast("bigint"), lambda a, c: a + f(c))
    return resources.select("namespace", "name", count(lambda c: c["ready"].cast("bigint")).alias("ready_containers"), F.size("containers").alias("containers"), count(lambda c: F.coalesce(c["restarts"], F.lit(0).cast("bigint"))).alias("restarts"))


def rum_target(kind: Column) -> Column:
    """The table that a browser event belongs to."""
    return F.when(kind == "view", "views").when(kind.isin("action", "resource", "error", "long_task"), "events").when(kind == "telemetry", "telemetry").when(kind == "timeseries", "timeseries").otherwise("unknown")


def flatten_tree(rows: DataFrame, tree: str, keep: list[str], children: str = "$.children", label: str | None = None) -> DataFrame:
    """(keep..., path, parent, node): a JSON tree taken apart at any depth; ``path`` is the list of child indexes from the root,
    ``parent`` the label of the node above. One level a round, each written, until a level is empty; a node's text is in its row only.
    """
    named = lambda c: F.get_json_object(c, label) if label else F.lit(None).cast("string")
    level = durable(rows.select(*keep, F.array(F.lit(0)).alias("path"), F.lit(None).cast("string").alias("parent"), F.col(tree).alias("node")).where("node is not null"))
    out = level
    while not level.isEmpty():
        below = F.posexplode(F.from_json(F.get_json_object("node", children), "array<string>")).alias("i", "child")
        level = durable(level.select(*keep, "path", named(F.col("node")).alias("parent"), below).select(*keep, F.array_append("path", F.col("i")).alias("path"), "parent", F.col("child").alias("node")))
        out = out.unionAll(level)
    return out


#: Where each kind of cluster object keeps its numbers, under the names that rows give them. ``#`` counts a list's members.
OBJECT_COUNTS = {
    "Deployment": {"ready": "$.readyReplicas", "desired": "$.replicasDesired", "updated": "$.updatedReplicas", "available": "$.availableReplicas", "unavailable": "$.unavailableReplicas", "replicas": "$.replicas"},
    "ReplicaSet": {"ready": "$.readyReplicas", "desired": "$.replicasDesired", "available": "$.availableReplicas", "replicas": "$.replicas", "fully_labeled": "$.fullyLabeledReplicas"},
    "DaemonSet": {"ready": "$.status.numberReady", "desired": "$.status.desiredNumberScheduled", "current": "$.status.currentNumberScheduled", "updated": "$.status.updatedNumberScheduled", "available": "$.status.numberAvailable", "misscheduled": "$.status.numberMisscheduled", "unavailable": "$.status.numberUnavailable"},
    "StatefulSet": {"ready": "$.status.readyReplicas", "desired": "$.spec.desiredReplicas", "current": "$.status.currentReplicas", "updated": "$.status.updatedReplicas", "replicas": "$.status.replicas", "partition": "$.spec.partition"},
    "Node": {"taints": "#$.taints", "images": "#$.status.images"},
    "Service": {"ports": "#$.spec.ports"},
    "Role": {"rules": "#$.rules"},
    "ClusterRole": {"rules": "#$.rules", "aggregation_rules": "#$.aggregationRules"},
    "RoleBinding": {"subjects": "#$.subjects"},
    "ClusterRoleBinding": {"subjects": "#$.subjects"},
    "Job": {"active": "$.status.active", "succeeded": "$.status.succeeded", "failed": "$.status.failed", "parallelism": "$.spec.parallelism", "completions": "$.spec.completions", "backoff_limit": "$.spec.backoffLimit", "active_deadline_seconds": "$.spec.activeDeadlineSeconds"},
    "CronJob": {"active_jobs": "#$.status.active", "suspend": "?$.spec.suspend", "successful_jobs_history_limit": "$.spec.successfulJobsHistoryLimit", "failed_jobs_history_limit": "$.spec.failedJobsHistoryLimit", "starting_deadline_seconds": "$.spec.startingDeadlineSeconds"},
    "HorizontalPodAutoscaler": {"min_replicas": "$.spec.minReplicas", "max_replicas": "$.spec.maxReplicas", "current_replicas": "$.status.currentReplicas", "desired_replicas": "$.status.desiredReplicas"},
    "PodDisruptionBudget": {"disruptions_allowed": "$.status.disruptionsAllowed", "current_healthy": "$.status.currentHealthy", "desired_healthy": "$.status.desiredHealthy", "expected_pods": "$.status.expectedPods", "disrupted_pods": "%$.status.disruptedPods"},
}
#: Which count is the object's readiness, if it has any, as (ready, desired, available).
OBJECT_READINESS = {
    "Deployment": ("ready", "desired", "available"), "ReplicaSet": ("ready", "desired", "available"), "DaemonSet": ("ready", "desired", "available"), "StatefulSet": ("ready", "desired", None),
    "HorizontalPodAutoscaler": ("current_replicas", "desired_replicas", None),
}
COUNTED = {"#": "array<struct<>>", "%": KEYS}  # what is only counted is not copied
POD_CONTAINERS = "array<struct<name:string,containerID:string,ready:boolean,restartCount:bigint,state:string,message:string,image:string,imageID:string>>"


def _counted(path: str, value: Callable[[tuple, str], Column]) -> Column:
    """A number of the object; 0 where it has none. ``value`` finds what is below keys."""
    held = value(steps(path.lstrip("#?%"))[1], COUNTED.get(path[0], "string"))
    found = {"#": F.size(held), "%": F.size(held), "?": held.try_cast("boolean").cast("int")}.get(path[0], held.try_cast("bigint"))
    return F.greatest(F.lit(0).cast("long"), F.coalesce(found.cast("long"), F.lit(0).cast("long"))) if path[0] in "#%" else F.coalesce(found.cast("long"), F.lit(0).cast("long"))


def object_rows(objects: DataFrame) -> DataFrame:
    """Cluster objects with what depends on their kind: ``counts`` under stable names, ready, desired and available, a pod's
    containers as aligned arrays (regular ones first, then those of its start), a node's facts, conditions as aligned arrays.

    A kind without rules has no counts; ``object`` keeps every object whole, as text.
    """
    statuses = lambda key: F.coalesce(below("object", (key,), POD_CONTAINERS), F.array().cast(POD_CONTAINERS))
    paths = ["$.restartCount", *(p for of in OBJECT_COUNTS.values() for p in of.values())]
    made, value = walked(Opened("object"), [(steps(p.lstrip("#?%"))[1], COUNTED.get(p[0], "string")) for p in paths], "n_")
    rows = objects.withColumns({**made, "regular": statuses("containerStatuses"), "first": statuses("initContainerStatuses")})
    ready = lambda c: F.size(F.filter(c, lambda x: F.coalesce(x["ready"], F.lit(False)))).cast("long")
    restarts = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["restartCount"], F.lit(0).cast("long")))
    pod = {
        "restarts": restarts("regular"), "ready_containers": ready("regular"), "total_containers": F.size("regular").cast("long"), "init_restarts": restarts("first"),
        "ready_init_containers": ready("first"), "total_init_containers": F.size("first").cast("long"), "pod_restart_count": _counted("$.restartCount", value),
    }
    table = {"Pod": pod} | {kind: {n: _counted(p, value) for n, p in of.items()} for kind, of in OBJECT_COUNTS.items()}
    counts = F.lit(None).cast("map<string,bigint>")
    for kind, made in table.items():
        counts = F.when(F.col("kind") == kind, F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*made.values()))).otherwise(counts)
    rows = rows.withColumn("counts", F.coalesce(counts, F.create_map().cast("map<string,bigint>")))
    readiness = {"Pod": ("ready_containers", "total_containers", None), **OBJECT_READINESS}
    part = lambda k: F.coalesce(*[F.when(F.col("kind") == kind, F.try_element_at("counts", F.lit(names[k]))) for kind, names in readiness.items() if names[k]])
    text = lambda p: there(F.col("object"), *steps(p)[1]).cast("string")
    of = lambda kind, p: F.when(F.col("kind") == kind, text(p))
    everyone = F.concat("regular", "first")
    aligned = {"name": "names", "containerID": "ids", "ready": "ready", "restartCount": "restarts", "state": "states", "message": "messages", "image": "images", "imageID": "image_ids"}
    conditions = {"type": "types", "status": "statuses", "reason": "reasons", "message": "messages", "lastTransitionTime": "last_transition_s", "lastUpdateTime": "last_update_s", "lastProbeTime": "last_probe_s"}
    taken = lambda c, f: F.transform(c, lambda x: x[f])
    each = lambda c, f: F.coalesce(taken(c, f), F.array())
    return rows.withColumns(
        {
            **{n: part(k) for k, n in enumerate(("ready", "desired", "available"))}, "phase": of("Pod", "$.phase"), "node_name": of("Pod", "$.nodeName"), "pod_ip": of("Pod", "$.IP"), "qos_class": of("Pod", "$.QOSClass"),
            "status": F.coalesce(of("Pod", "$.status"), of("Node", "$.status.status"), of("Namespace", "$.status")), "kubelet_version": of("Node", "$.status.kubeletVersion"), "os_image": of("Node", "$.status.osImage"),
            "unschedulable": of("Node", "$.unschedulable").try_cast("boolean"), "roles": F.when(F.col("kind") == "Node", F.try_variant_get("object", "$.roles", "array<string>")), "capacity": F.when(F.col("kind") == "Node", F.try_variant_get("object", "$.status.capacity", "map<string,bigint>")),
            "allocatable": F.when(F.col("kind") == "Node", F.try_variant_get("object", "$.status.allocatable", "map<string,bigint>")), "service_type": of("Service", "$.spec.type"), "cluster_ip": of("Service", "$.spec.clusterIP"),
            **{f"container_{c}": taken(everyone, f) for f, c in aligned.items()}, "container_is_init": F.concat(F.transform("regular", lambda _: F.lit(0)), F.transform("first", lambda _: F.lit(1))),
            **{f"condition_{c}": each("conditions", f) for f, c in conditions.items()}, "labels": last_of(_pairs("labels")), "annotations": last_of(_pairs("annotations")), "object": F.to_json("object"),
            "tags": multimap(F.concat(F.coalesce("envelope_tags", F.array().cast("array<string>")), F.flatten(F.transform(F.map_entries("tags"), lambda e: F.transform(e["value"], lambda v: F.when(v == "", e["key"]).otherwise(F.concat(e["key"], F.lit(":"), v))))))),
        }
    ).drop(*made, "regular", "first", "conditions", "envelope_tags")


def _pairs(name: str) -> Column:
    split = lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.when(F.contains(x, F.lit(":")), F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise("").alias("value"))
    return F.coalesce(F.transform(name, split), F.array().cast(PAIRS))


def container_rows(landing: DataFrame, stats: bool = False) -> DataFrame:
    """Containers, or their statistics, of every message that has them, with ``source``, which message that was; a container on a process has its ``pid``."""
    out = None
    for source, spec in (STAT_MESSAGES if stats else CONTAINER_MESSAGES).items():
        rows = normalise(landing, spec)[0].where("container_id is not null").withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


SUMMARY = "struct<mapping:struct<gamma:double,indexOffset:double>,positiveValues:struct<binCounts:map<string,double>,contiguousBinCounts:array<double>,contiguousBinIndexOffset:bigint>,negativeValues:struct<binCounts:map<string,double>,contiguousBinCounts:array<double>,contiguousBinIndexOffset:bigint>,zeroCount:double>"
BINS = "array<struct<key:bigint,n:double>>"


def _bins(store: Column) -> Column:
    """A store's bins as (key, count): the sparse ones by their keys, the dense ones from their offset on."""
    sparse = F.transform(F.map_entries(store["binCounts"]), lambda e: F.struct(e["key"].try_cast("bigint").alias("key"), e["value"].alias("n")))
    dense = F.transform(store["contiguousBinCounts"], lambda n, i: F.struct((F.coalesce(store["contiguousBinIndexOffset"], F.lit(0).cast("long")) + i).alias("key"), n.alias("n")))
    return F.concat(F.coalesce(sparse, F.array().cast(BINS)), F.coalesce(dense, F.array().cast(BINS)))


def with_summary(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """What a latency summary says: ``_state`` (absent, undecodable, empty, ok), ``_gamma``, ``_keys`` and ``_counts`` (ascending by value; a bin of
    negative values has the key -key - 2e9, that of zeros -1e9), ``_count``."""
    made, apart = F.col("_made"), F.lit(1_000_000_000).cast("long")
    moved = lambda bins, key: F.transform(bins, lambda b: F.struct(key(b["key"]).alias("key"), b["n"].alias("n")))
    zero = F.filter(F.array(F.struct((-apart).alias("key"), F.coalesce(made["zeroCount"], F.lit(0.0)).alias("n"))), lambda b: b["n"] > 0)
    everything = F.concat(moved(_bins(made["negativeValues"]), lambda k: -k - 2 * apart), zero, _bins(made["positiveValues"]))
    rows = rows.withColumn("_made", F.try_variant_get(raw, "$", SUMMARY)).withColumn("_all", everything).withColumn("_bins", F.array_sort(F.filter("_all", lambda b: b["n"] > 0)))
    bins = F.col("_bins")
    gamma = made["mapping"]["gamma"]
    odd = F.exists("_all", lambda b: b["key"].isNull() | b["n"].isNull() | (b["n"] < 0)) | (gamma <= 1)
    state = F.when(F.col(raw).isNull(), "absent").when(made.isNull() | gamma.isNull() | odd, "undecodable").when(F.size(bins) == 0, "empty").otherwise("ok")
    fine = F.col(f"{name}_state") == "ok"
    return rows.withColumn(f"{name}_state", staying(state)).withColumns({
        f"{name}_gamma": F.when(fine, gamma), f"{name}_offset": F.when(fine, F.coalesce(made["mapping"]["indexOffset"], F.lit(0.0))), f"{name}_keys": staying(F.when(fine, F.transform(bins, lambda b: b["key"]))),
        f"{name}_counts": F.when(fine, F.transform(bins, lambda b: b["n"])), f"{name}_count": F.when(fine, F.aggregate(bins, F.lit(0.0), lambda s, b: s + b["n"])),
    }).drop("_made", "_all", "_bins")


def stat_rows(stats: DataFrame) -> DataFrame:
    """Grouped trace statistics with both latency summaries taken apart; a summary that is none stays a row, and says so. The tags of
    the client as a map of lists."""
    return with_summary(with_summary(stats, "ok_summary", "ok"), "error_summary", "error").withColumns({"client_tags": multimap(F.col("client_tags"))}).drop("ok_summary", "error_summary")


def latency_quantiles(stats: DataFrame, keys: list[str], q: float, name: str = "ok") -> DataFrame:
    """(keys..., gamma, count, value): the q-quantile of the merged summaries, from bins summed map-side; summaries of one mapping merge.

    The value stands for its bin within its relative error, (gamma - 1) / (gamma + 1)."""
    by = [*keys, "_gamma", "_offset"]
    cells = stats.where(F.col(f"{name}_state") == "ok").select(*keys, F.col(f"{name}_gamma").alias("_gamma"), F.col(f"{name}_offset").alias("_offset"), F.explode(F.arrays_zip(F.col(f"{name}_keys").alias("k"), F.col(f"{name}_counts").alias("n"))).alias("_b"))
    cells = cells.groupBy(*by, F.col("_b.k").alias("_k")).agg(F.sum("_b.n").alias("_n"))  # as many rows as bins, whatever the spans
    run = Window.partitionBy(*by).orderBy("_k")
    cells = cells.withColumn("_run", F.sum("_n").over(run)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    apart = 1_000_000_000
    size = lambda k: F.pow(F.col("_gamma"), k - F.col("_offset")) * 2 / (1 + F.col("_gamma")) * F.col("_gamma")
    value = F.when(F.col("_k") == -apart, 0.0).when(F.col("_k") < -apart, -size(-F.col("_k") - 2 * apart)).otherwise(size(F.col("_k")))
    first = cells.where(F.col("_run") > q * (F.col("_all") - 1)).groupBy(*by).agg(F.min_by(value, "_k").alias("value"), F.max("_all").alias("count"))
    return first.select(*keys, F.col("_gamma").alias("gamma"), "count", "value")
