"""Text predicates and scalars as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

REDACTED = "<redacted>"
_GO_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PATH = r"(?:/\S+|[A-Za-z]:\\\S*|\\\\\S+)"
_UNSEEN = r"[\p{Cc}\p{Cf}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """Number of maximal runs without ASCII white space."""
    return F.size(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[^ \t\n\r\x0B\f]+"), F.lit(0)))


def fields(c) -> Column:
    """Runs without Unicode white space."""
    return F.filter(F.split(col(c), _GO_SPACE + "+"), lambda x: x != "")


def one_line(c) -> Column:
    return F.array_join(fields(c), " ")


def trimmed(c) -> Column:
    return F.regexp_replace(col(c), f"^{_GO_SPACE}+|{_GO_SPACE}+$", "")


def letters(c) -> Column:
    """Runs of a to z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def content_free(c, most: int = 5) -> Column:
    """A short turn of approval words only. A text of more words is told by its first ones, without listing all."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    approved = F.array(*map(F.lit, dict.fromkeys(vocab.APPROVALS)))
    longer = text.rlike(rf"\A[^a-z]*+(?:[a-z]++[^a-z]++){{{most}}}[a-z]")
    return F.when(longer, False).otherwise((F.size(letters(c)) > 0) & (F.size(F.array_except(letters(c), approved)) == 0))


def is_placeholder(c) -> Column:
    """Values of a template's, a mask's or a stand-in's shape; an empty value is none."""
    t = trimmed(F.coalesce(col(c), F.lit("")))
    # The four shapes.
    template = t.rlike(r"\A(<[^\n]*>|\$\{?[A-Za-z0-9_]+\}?|\{\{[^\n]*\}\}|%[A-Za-z0-9_]+%)\z")
    masked = t.rlike(r"(\*{3,}|[xX]{4,}|…{3,}|•{3,})")
    pronoun = t.rlike(r"(?i)\A(your|my|the)[_\-]")
    capitals = t.rlike(r"\A[A-Z0-9_]*[A-Z_][A-Z0-9_*]*\z") & t.rlike(r"[_*]")
    return (t != "") & (template | masked | pronoun | F.lower(t).isin(vocab.PLACEHOLDER_WORDS) | capitals)


def placeholders(c) -> Column:
    """The runs without ASCII white space that are placeholders. One pass over the text finds all that may be, by a sign of each shape;
    only these are judged."""
    word, stand_ins = r"[^ \t\n\r\x0B\f]", "|".join(vocab.PLACEHOLDER_WORDS)
    starts = rf"[{_GO_SPACE}&&{word}]*+(?:[<$%]|\{{\{{|(?i:your|my|the)[_\-]|(?iu:{stand_ins})(?={_GO_SPACE}|\z)|[A-Z0-9]*+[_*])"
    inside = rf"{word}*?(?:\*{{3}}|[xX]{{4}}|…{{3}}|•{{3}})"
    run = rf"(?<!{word})(?:{starts}|{inside}){word}*+"
    return F.filter(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(run), F.lit(0)), is_placeholder)


def mask(label, value) -> Column:
    """An e-mail keeps its host, a long value its last four code points."""
    v, tail = col(value), 4
    rest = F.when(F.length(v) <= tail + 2, F.lit("***")).otherwise(F.concat(F.lit("…"), F.right(v, F.lit(tail))))
    return F.when((col(label) == "email") & F.contains(v, F.lit("@")), F.concat(F.lit("***@"), F.substring_index(v, "@", -1))).otherwise(rest)


def cap_field(c, most_bytes: int = 120, most_words: int = 3) -> Column:
    v = col(c)
    return F.when((F.octet_length(v) > most_bytes) | (F.size(fields(v)) > most_words), F.lit(REDACTED)).otherwise(v)


def redact_string(c) -> Column:
    """No control characters, paths or free text leave: a whole path keeps its last segment."""
    v = col(c)
    base = F.regexp_extract(v, r"([^/\\]*)\z", 1)
    return F.when(v.rlike(_UNSEEN), REDACTED).when(v.rlike(rf"\A{_PATH}\z"), cap_field(base)).when(v.rlike(rf"(^|[^\w]){_PATH}"), REDACTED).otherwise(cap_field(v))


def redact_error(kind, message, most: int = 200) -> Column:
    """`Kind: message` with paths cut out; an unsafe message goes, the kind stays."""
    m = F.regexp_replace(F.regexp_replace(col(message), r"[\t\n\r\x0B\f]+", " "), rf"(^|[^\w]){_PATH}", "$1<path>")
    m = F.when(m.rlike(_UNSEEN), F.lit(REDACTED)).otherwise(cap_field(m))
    whole = F.concat(col(kind), F.lit(": "), m)
    return F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("…"))).otherwise(whole)


def redact_map(c) -> Column:
    """A flat map of strings: nulls go, strings are redacted, numbers and booleans (by their form) pass."""
    plain = r"\A(?:true|false|-?\d+(?:\.\d+)?)\z"
    kept = F.map_filter(col(c), lambda k, v: v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.when(v.rlike(plain), v).otherwise(redact_string(v)))


def redact_json(c, depth: int = 16) -> Column:
    """A JSON object with every value vetted, by its real type: numbers and booleans pass, strings are redacted, objects recurse, nulls and
    arrays go, and so do objects below `depth`. '{}' for what is no JSON object; keys of the result are sorted."""
    parsed = F.try_parse_json(col(c))

    def kind(v: Column) -> Column:
        return F.schema_of_variant(v)

    def entries(v: Column, left: int) -> Column:
        kept = F.map_filter(v.cast("map<string,variant>"), lambda k, x: passes(x, left))
        return F.to_variant_object(F.transform_values(kept, lambda k, x: value(x, left)))

    def passes(v: Column, left: int) -> Column:
        return v.isNotNull() & ~F.is_variant_null(v) & ~kind(v).startswith("ARRAY") & (~kind(v).startswith("OBJECT") | F.lit(left > 0))

    def value(v: Column, left: int) -> Column:
        out = F.when(kind(v) == "STRING", redact_string(v.cast("string")).cast("variant"))
        return out.when(kind(v).startswith("OBJECT"), entries(v, left - 1)).otherwise(v) if left else out.otherwise(v)

    return F.when(kind(parsed).startswith("OBJECT"), F.to_json(entries(parsed, depth - 1))).otherwise(F.lit("{}"))


def clip(c, most: int = 24000) -> Column:
    return F.substring(col(c), 1, most)


def luhn(c) -> Column:
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def entities(c, label: str) -> Column:
    """Texts of one kind. A cheap sign of it is looked for before the pattern runs."""
    text = F.coalesce(col(c), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(vocab.ENTITY_PATTERNS[label]), F.lit(0))
    if label in vocab.ENTITY_SIGNS:
        sign = reduce(or_, (F.contains(text, F.lit(x)) for x in vocab.ENTITY_SIGNS[label]))
    else:
        sign = text.rlike(vocab.ENTITY_HINTS[label])
    found = F.when(sign, found).otherwise(F.array().cast("array<string>"))
    return F.filter(found, luhn) if label == "credit_card" else found


def severity_class(labels) -> Column:
    """The class of the first rule that any label meets; null if none does."""
    out = None
    for name, triggers in vocab.SEVERITY_RULES:
        hit = F.arrays_overlap(col(labels), F.array(*map(F.lit, triggers)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def shannon(c) -> Column:
    """Bits per byte of a string, natively: counts of its bytes' two hex digits."""
    v = F.coalesce(col(c), F.lit(""))
    h = F.hex(v.cast("binary"))
    codes = F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))
    n = F.size(codes).cast("double")
    parts = F.transform(F.array_distinct(codes), lambda x: F.size(F.filter(codes, lambda y: y == x)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def safe_name(c) -> Column:
    return F.regexp_replace(col(c), r"\.\.|[/\\]", "_")


def preamble(meta: str = "meta", agentic: bool = False) -> Column:
    """The context block before a text; meta: a struct of repo, branch, project, tool, recent_prompts and, where agentic, framework, agent_role, workflow, step, recent_steps."""

    def part(name: str, field: str) -> Column:
        v = F.col(f"{meta}.{field}")
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(name + ": "), v))

    def numbered(title: str, field: str) -> Column:
        items = F.coalesce(F.col(f"{meta}.{field}"), F.array().cast("array<string>"))
        lines = F.transform(items, lambda x, i: F.concat(F.lit(" "), (i + 1).cast("string"), F.lit(". "), x, F.lit("\n")))
        return F.when(F.size(items) > 0, F.concat(F.lit(title + " (newest first):\n"), F.array_join(lines, ""))).otherwise("")

    parts = [F.coalesce(part("repository", "repo"), F.lit("repository: none")), part("branch", "branch"), part("project", "project"), part("tool", "tool")]
    if agentic:
        parts += [part("framework", "framework"), part("agent", "agent_role"), part("workflow", "workflow"), part("step", "step")]
    steps = numbered("Recent steps", "recent_steps") if agentic else F.lit("")
    return F.concat(F.lit("[Context — "), F.concat_ws("; ", *parts), F.lit("]\n"), numbered("Recent prompts", "recent_prompts"), steps, F.lit("Task: "))


def budgeted(prompts, each: int = 400, total: int = 1500) -> Column:
    """Newest-first prompts on one line each, capped in code points, taken while their bytes fit; the first always is."""
    lines = F.filter(F.transform(col(prompts), one_line), lambda x: x != "")
    lines = F.transform(lines, lambda x: F.when(F.length(x) > each, F.concat(F.left(x, F.lit(each)), F.lit("…"))).otherwise(x))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["full"] | ((acc["n"] + F.octet_length(x) > total) & (F.size(acc["kept"]) > 0))
        return F.struct(
            F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
            F.when(over, acc["n"]).otherwise(acc["n"] + F.octet_length(x)).alias("n"),
            over.alias("full"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["kept"])


def versioned(name: str) -> str:
    return f"{name}-v{vocab.SCHEMA_VERSION}"


def custom_producer(key: str, version: str | None) -> str:
    return f"{key}-c{version}" if version else f"{key}-custom"
