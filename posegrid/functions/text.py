"""Column functions over names, instructions and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.rand import seeded


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def output_scene(name: Column) -> Column:
    """Scene of an output file: without output_, and without every occurrence of the first token and its _."""
    rest = F.regexp_replace(name, "^output_", "")
    return F.replace(rest, F.concat(F.substring_index(rest, "_", 1), F.lit("_")), F.lit(""))


def reroot(path: Column, prefix: str, root: str) -> Column:
    """Paths under prefix moved under root; others put under root as they are."""
    return F.when(path.startswith(prefix), F.concat(F.lit(root), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))).otherwise(F.concat(F.lit(root), path))


def episode_id(scene: Column, style: Column, n: Column) -> Column:
    return F.concat_ws("_", F.replace(scene, F.lit("/"), F.lit("-")), style, F.lpad(n.cast("string"), 4, "0"))


def clean_instruction(context: Column, response: Column, kind: Column, template: str, most: int = 100) -> Column:
    """Context, else response; over `most` characters the template; object becomes the kind, a
    leading number goes; null if empty or object is still named."""
    text = F.coalesce(F.nullif(context, F.lit("")), response)
    text = F.when(F.length(text) > most, F.lit(template)).otherwise(text)
    text = F.trim(F.regexp_replace(F.replace(text, F.lit("object"), kind), r"^[0-9]+\.\s*", ""))
    return F.when((text == "") | F.contains(text, F.lit("object")), None).otherwise(text)


def fill_template(templates: list[str], seed: int, key: Column, value: Column) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, templates)), (seeded(seed, key) % len(templates) + 1).cast("int")), F.lit("{object}"), value)


STYLES, SYNTAX, TONES = ("brief", "detailed", "landmark"), ("imperative", "question"), ("plain", "polite", "casual", "urgent")


def style_prompt(seed: int, key: Column) -> Column:
    pick = lambda xs, tag: F.element_at(F.array(*map(F.lit, xs)), (seeded(f"{seed}{tag}", key) % len(xs) + 1).cast("int"))
    return F.concat_ws("/", pick(STYLES, "s"), pick(SYNTAX, "x"), pick(TONES, "t"))


PREFIXES = ("you see", "next you see", "now you see", "then you see", "ahead you see", "around you see")


def round_prefix(i: Column, every: int = 8) -> Column:
    """Prefix by round modulo their number, with a reminder every few rounds."""
    p = F.element_at(F.array(*map(F.lit, PREFIXES)), (i % len(PREFIXES) + 1).cast("int"))
    return F.when((i > 0) & (i % every == 0), F.concat(p, F.lit(" (remember the task)"))).otherwise(p)


def action_tokens(text: Column) -> Column:
    """Actions named in free text, in order: array of ids."""
    found = F.regexp_extract_all(text, F.lit("(STOP|↑|←|→)"), F.lit(1))
    return F.transform(found, lambda t: F.when(t == "STOP", 0).when(t == "↑", 1).when(t == "←", 2).otherwise(3))


def verdict(text: Column) -> tuple[Column, Column]:
    """(accepted, text): INVALID before INSTRUCTION rejects, with what follows it as reason; else the
    text after INSTRUCTION: without fences and quotes; without the tag the whole text."""
    bad, tag = F.instr(text, "INVALID"), F.instr(text, "INSTRUCTION:")
    rejected = (bad > 0) & ((tag == 0) | (bad < tag))
    reason = F.trim(F.regexp_replace(F.substring(text, bad + 7, F.length(text)), "^[:\\s]+", ""))
    body = F.when(tag > 0, F.substring(text, tag + 12, F.length(text))).otherwise(text)
    return ~rejected, F.when(rejected, reason).otherwise(F.trim(F.regexp_replace(F.trim(F.regexp_replace(body, "```", "")), '^"+|"+$', "")))


def truncate(text: Column, n: int = 2000) -> Column:
    return F.coalesce(F.substring(text, 1, n), F.lit(""))


def ratios(json: Column) -> Column:
    """Map of ratios; empty where the JSON does not parse."""
    return F.coalesce(F.from_json(json, "map<string,double>"), F.create_map().cast("map<string,double>"))


def marked_spans(tokens: Column, start: str, end: str) -> Column:
    """Tokens between start and end markers; others, and the markers, null. Null if there is none.
    Each token looks at the markers only, of which a text has few."""
    marks = F.filter(F.transform(tokens, lambda t, i: F.when((t == start) | (t == end), F.struct(i.alias("i"), (t == start).alias("opens")))), lambda m: m.isNotNull())
    last = lambda i: F.array_max(F.filter(marks, lambda m: m.i <= i))
    inside = F.transform(tokens, lambda t, i: F.when((t != start) & (t != end) & F.coalesce(last(i).opens, F.lit(False)), t))
    return F.when(F.exists(inside, lambda t: t.isNotNull()), inside)


def parse_descriptor(col: Column) -> tuple[Column, Column, Column]:
    """Name, options and whether only root, extra and split are given, of Name:key=value:..."""
    name = F.substring_index(col, ":", 1)
    rest = F.substring(col, F.length(name) + 2, F.length(col))
    opts = F.when(rest == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(rest, F.lit(":"), F.lit("=")))
    return name, opts, F.forall(F.map_keys(opts), lambda k: k.isin("root", "extra", "split"))


#: Classes of objects that can be handled.
MANIPULATION = (
    "doorknob", "door handle", "drawer pull", "light switch", "power outlet", "faucet", "thermostat", "soap", "soap dispenser", "toothbrush", "toothpaste", "shampoo",
    "toilet paper", "tissue", "sponge", "plunger", "plate", "bowl", "cup", "mug", "glass", "wine glass", "bottle", "jug", "pitcher", "pot", "pan", "skillet", "tray",
    "cutting board", "knife", "fork", "spoon", "spatula", "whisk", "can opener", "saltshaker", "pepper shaker", "napkin", "laptop", "tablet", "keyboard", "mouse",
    "telephone", "camera", "router", "speaker", "clock", "book", "notebook", "folder", "binder", "pen", "pencil", "marker", "eraser", "scissors", "stapler", "tape",
    "wallet", "keys", "glasses", "shoe", "boot", "sneaker", "slipper", "sock", "hat", "cap", "glove", "scarf", "tie", "belt", "box", "carton", "basket", "bag", "handbag", "purse",
)


def class_group(cls: Column, manipulation: tuple[str, ...] = MANIPULATION) -> Column:
    """manipulation for classes that can be handled, else other; null for null."""
    return F.when(cls.isin(*manipulation), "manipulation").when(cls.isNotNull(), "other")


def with_vocabulary(objects: DataFrame, vocabulary: DataFrame, known_only: bool = True) -> DataFrame:
    """objects (with cls) with grp, the group that the vocabulary (cls, grp), a dimension table of the
    user's, gives their class. Classes outside it are dropped, as a detector that is asked for the
    vocabulary finds none; or kept, with a null grp. Of a class with several groups the least counts."""
    one = vocabulary.where("cls IS NOT NULL").groupBy("cls").agg(F.min("grp").alias("grp"))
    return objects.drop("grp").join(one, "cls", "inner" if known_only else "left").select(*[c for c in objects.columns if c != "grp"], "grp")
