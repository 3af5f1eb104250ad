"""Text functions on columns: cleaning, keyword classes, references, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keyword groups of the category function, first match wins.
CATEGORY_WORDS = [
    ("Land Use & Zoning", ["zoning", "development", "building", "city plan"]),
    ("Transportation", ["traffic", "highway", "parking", "vehicle"]),
    ("Public Safety", ["fire", "alarm", "firearm", "firework", "flood"]),
    ("Animals", ["animal"]),
    ("Business & Licensing", ["business", "licence", "accommodation"]),
    ("Environment", ["climate", "waste", "water", "dust"]),
    ("Parks & Recreation", ["park", "recreation", "cemetery"]),
    ("Administration & Governance", ["council", "election", "ethics", "conduct", "procedure", "privacy"]),
    ("Finance", ["financial", "fund", "fees", "charge", "tax", "borrowing"]),
]
# Action words in order of precedence, and the openings of motions.
ACTION_WORDS = ["adopted", "passed", "reading", "rescinded", "amended", "deferred", "directed", "approved", "endorsed", "received", "referred", "denied"]
MOTION_OPENINGS = [
    "Council directed", "Council approved", "Council endorsed", "Council adopted", "Council deferred", "Council referred", "Council denied", "Council received", "Council supported",
]
# Patterns of references.
REFERENCE = r"(?i)(?<![\p{L}\p{N}_])Bylaw(?:\s+Amendment)?(?:\s+[0-9]{4})?\s+(?:No\.?\s*)?([0-9]{3,4}(?:\.[0-9]+)*)"
NUMBER_IN_TEXT = r"(?i)(?:NO\.?\s*|ViewBylaw/)([0-9]{3,4}(?:\.[0-9]+)*)"
ABBREVIATION = r"(?i)(?<![\p{L}\p{N}_])(No|Nos|St|Mt|Dr|Mr|Ms)\."
MAX_TEXT, MAX_CHUNK, MIN_LINE = 2_000_000, 2400, 12


def first_truthy(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty. Columns hold text, for which "0" and "false" are values like any
    other; numbers, booleans and lists have ``first_value``."""
    def kept(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.when(c.cast("string") != "", c)

    return F.coalesce(*map(kept, columns))


def first_value(df: DataFrame, *names: str) -> Column:
    """The first of some columns that isn't null nor, by the type of each, empty, zero or false."""
    def kept(name):
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.StringType):
            return F.when(c != "", c)
        if isinstance(kind, T.BooleanType):
            return F.when(c, c)
        if isinstance(kind, T.NumericType):
            return F.when(c != 0, c)
        return F.when(F.size(c) > 0, c) if isinstance(kind, (T.ArrayType, T.MapType)) else c

    return F.coalesce(*map(kept, names))


# A category's later name, and the departments of categories.
RENAMED = {"Transportation & Parking": "Transportation"}
DEPARTMENTS = {
    "Administration & Governance": "Legislative Services", "Animals": "Bylaw Services", "Business & Licensing": "Business Licensing", "Environment": "Engineering & Public Works", "Finance": "Finance",
    "Land Use & Zoning": "Development Services", "Other": "Corporate Services", "Parks & Recreation": "Parks, Recreation & Culture", "Public Safety": "Public Safety", "Transportation": "Engineering & Public Works",
}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(default)


def as_boolean(c: Column) -> Column:
    """Whether a setting is on; whatever isn't a yes is off."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes", "on"), F.lit(False))


def as_list(c: Column) -> Column:
    """A single choice as a list: empty for none."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.trim(c)))


def normalize_number(c: Column) -> Column:
    """Trimmed, without dots at the end."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[.]+$", "")


def _plain_letters() -> dict[str, str]:
    """Accented Latin letters by their base, from their decompositions."""
    import unicodedata

    bases: dict[str, str] = {}
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(code).lower())
        if len(parts) > 1 and "a" <= parts[0] <= "z":
            bases[parts[0]] = bases.get(parts[0], "") + chr(code)
    return bases


def name_slug(c: Column) -> Column:
    """The slug of a page's name: lower case, letters taken apart from their marks, all else a hyphen. A mark within a
    word becomes a hyphen too, unless it ends up beside one or at an end."""
    low = F.lower(F.coalesce(c, F.lit("")))
    for base, accented in _plain_letters().items():
        low = F.regexp_replace(low, f"[{accented}]", base)
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", "")


def normalize_category(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(_literal_map(RENAMED)[text], text)


def department(explicit: Column, category: Column, default: str = "Corporate Services") -> Column:
    """The explicit department, else the category's, else the default."""
    return first_truthy(explicit, F.coalesce(_literal_map(DEPARTMENTS)[normalize_category(category)], F.lit(default)))


def committee_name(title: Column, name: Column, default: str = "Committee, board or panel") -> Column:
    return F.trim(first_truthy(title, name, F.lit(default)))


def numeric_key(c: Column) -> Column:
    """The number by which records are sorted: groups of digits, padded to five, with a decimal point between.

    Without digits it is -Infinity; more than two groups are no number and give null.
    """
    parts = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), 0), lambda x: F.when(F.length(x) < 5, F.lpad(x, 5, "0")).otherwise(x))
    return F.when(F.size(parts) == 0, F.lit(float("-inf"))).when(F.size(parts) <= 2, F.array_join(parts, ".").cast("double"))


def natural_key(c: Column) -> Column:
    """A key that sorts texts as people do: letters without regard to case and accents, and runs of digits by their value.

    Every letter is compared under the Unicode collation, so marks and ignorable characters of their own are taken out first; a
    run of digits stands among them as a digit does, and between two runs the length without leading zeros
    decides, then the digits.
    """
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{M}\p{Cc}\p{Cf}]", "")
    pieces = F.regexp_extract_all(plain, F.lit(r"(?s)[0-9]+|[^0-9]"), F.lit(0))
    def place(x):
        digits = F.when(x.rlike("^[0-9]"), F.regexp_replace(x, "^0+(?=[0-9])", "")).otherwise("")
        return F.struct(F.collate(F.when(digits != "", "0").otherwise(x), "UNICODE_CI_AI").alias("letter"), F.length(digits).alias("n"), digits.alias("digits"))

    return F.transform(pieces, place)


def ordered_strings(c: Column) -> Column:
    """The members of a list as texts, each once, in order of first occurrence; nothing for no list."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, lambda x: x.cast("string")), lambda x: x.isNotNull())), F.array().cast("array<string>"))


def toggle(members: Column, value: Column) -> Column:
    """The set without the value where it has it, else with it at its end."""
    return F.when(F.array_contains(members, value), F.array_remove(members, value)).otherwise(F.array_append(members, value))


def normalize_space(c: Column) -> Column:
    """Non-breaking and all other Unicode blanks and separators collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def slugify(c: Column, limit: int = 100, default: str = "meeting") -> Column:
    dashed = F.regexp_replace(F.lower(normalize_space(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit), F.lit("")), F.lit(default))


def page_slug(c: Column) -> Column:
    """The pages' own slug: no length limit, one dash off either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def number_from(text: Column, href: Column) -> Column:
    return F.nullif(F.regexp_extract(F.concat_ws(" ", text, href), NUMBER_IN_TEXT, 1), F.lit(""))


def year_from(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def keyword_category(c: Column, groups=None, default: str = "Other") -> Column:
    """The first group with a word that occurs anywhere in the lower-cased text."""
    low, out = F.lower(c), None
    for name, words in groups or CATEGORY_WORDS:
        test = F.coalesce(low.rlike("|".join(words)), F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def references(c: Column) -> Column:
    """All referenced numbers, in order."""
    return F.regexp_extract_all(c, F.lit(REFERENCE), 1)


def match_places(c: Column, pattern: str) -> Column:
    """All matches of a pattern, in order, as (at, text); places count from 1.

    A match starts after all that stands between matches, and all matches, before it: the running sum of the lengths of what
    the pattern splits and what it finds.
    """
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    steps = F.arrays_zip(found.alias("text"), F.slice(between, F.lit(1), F.size(found)).alias("gap"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,text:string>>").alias("found"))
    def add(done, step):
        at = done["at"] + F.length(step["gap"])
        return F.struct((at + F.length(step["text"])).alias("at"), F.array_append(done["found"], F.struct(at.alias("at"), step["text"].alias("text"))).alias("found"))

    return F.aggregate(steps, start, add, lambda done: done["found"])


def item_action(c: Column) -> Column:
    low, out = F.lower(c), None
    ordinal = F.regexp_extract(low, r"\b((?:first|second|third|three)\s+readings?)\b", 1)
    for word in ACTION_WORDS:
        value = F.when(ordinal != "", F.initcap(ordinal)).otherwise("Reading") if word == "reading" else F.lit(word.title())
        out = F.when(low.contains(word), value) if out is None else out.when(low.contains(word), value)
    return out.otherwise("Discussed")


def is_motion(c: Column) -> Column:
    """Case-sensitive opening, and no mention of a bylaw."""
    return c.rlike("^(?:" + "|".join(MOTION_OPENINGS) + ")") & ~F.lower(c).contains("bylaw")


def change_type(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.rlike("repeal|replace|rescind"), "repealed").when(low.contains("consolidat"), "consolidated")
        .when(low.contains("amend") | low.contains("reading") | (low == "changed"), "amended").otherwise("new")
    )


def classify_document(label: Column, url: Column) -> Column:
    low = F.lower(F.concat_ws(" ", label, url))
    out = F.when(low.contains("revised") & low.contains("agenda"), "revised-agenda").when(low.contains("minute"), "minutes")
    for word in ("notice", "agenda", "report"):
        out = out.when(low.contains(word), word)
    return out.otherwise("attachment")


# Fixed values: (word in the title, published name or None for the title itself, its default, group).
MEETING_KINDS = [
    ("public hearing", "Public Hearing", None, "public-hearing"),
    ("regular council", "Regular Council", None, "council"),
    ("special council", "Special Council", None, "council"),
    ("governance and priorities", "Governance and Priorities Committee", None, "committee"),
    ("finance and audit", "Finance and Audit Committee", None, "committee"),
    ("committee", None, "Committee meeting", "committee"),
    ("board", None, "Board meeting", "board"),
    ("commission", None, "Commission meeting", "commission"),
    ("panel", None, "Panel meeting", "panel"),
    ("task force", None, "Advisory group meeting", "committee"),
    ("working group", None, "Advisory group meeting", "committee"),
]


def classify_meeting(title: Column) -> tuple[Column, Column]:
    """(name, group) of a meeting by its title."""
    clean = normalize_space(F.coalesce(title, F.lit("")))
    low, name, group = F.lower(clean), None, None
    for word, fixed, default, kind in MEETING_KINDS:
        value = F.lit(fixed) if fixed else first_truthy(clean, F.lit(default))
        name = F.when(low.contains(word), value) if name is None else name.when(low.contains(word), value)
        group = F.when(low.contains(word), kind) if group is None else group.when(low.contains(word), kind)
    return name.otherwise(first_truthy(clean, F.lit("Council meeting"))), group.otherwise("council")


COMMITTEE_GROUPS = ["committee", "board", "commission", "panel"]
COMMITTEE_WORDS = "committee|board|commission|panel|task force|working group|governance and priorities|finance and audit"


def _titles(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def committee_by_collector(group: Column, *titles: Column) -> Column:
    """Explicit group, else the class of the joined titles (so a regular council outranks a committee)."""
    explicit = F.lower(normalize_space(F.coalesce(group, F.lit(""))))
    joined = F.concat_ws(" ", *[normalize_space(F.coalesce(c, F.lit(""))) for c in titles])
    return explicit.isin(COMMITTEE_GROUPS) | classify_meeting(joined)[1].isin(COMMITTEE_GROUPS)


def committee_by_verifier(group: Column, *titles: Column) -> Column:
    """Explicit group, else any committee word."""
    return F.lower(F.coalesce(group, F.lit(""))).isin(COMMITTEE_GROUPS) | _titles(*titles).rlike(COMMITTEE_WORDS)


def committee_by_sender(group: Column, *titles: Column) -> Column:
    """Explicit council groups are never committees; two more groups are."""
    explicit = F.lower(F.trim(F.coalesce(group, F.lit(""))))
    return F.when(explicit.isin(*COMMITTEE_GROUPS, "task-force", "working-group"), True).when(explicit.isin("council", "public-hearing"), False).otherwise(_titles(*titles).rlike(COMMITTEE_WORDS))


def committee_by_page(group: Column, *titles: Column) -> Column:
    """Words in the titles override an explicit council."""
    return F.lower(F.coalesce(group, F.lit(""))).isin(COMMITTEE_GROUPS) | _titles(*titles).rlike(COMMITTEE_WORDS)


def activity_label(action: Column, status: Column, title: Column, committee: Column) -> Column:
    low = F.lower(F.concat_ws(" ", action, status, title))
    return (
        F.when(low.rlike("refer(?:red|ral)? to council"), "Referred to Council")
        .when(low.rlike("received for information|information only"), "Received for information")
        .when(low.contains("recommend"), "Committee recommendation").when(low.rlike("motion|moved|carried"), "Committee motion")
        .when(committee, "Committee item").otherwise("Council item")
    )


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


def html_escape(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def html_to_text(c: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return normalize_space(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))


def html_unescape(c: Column) -> Column:
    """The named characters of HTML that html_escape makes, and the blank that doesn't break."""
    for mark, names in (("<", ("&lt;",)), (">", ("&gt;",)), ('"', ("&quot;", "&#34;")), ("'", ("&#39;", "&apos;")), ("\u00a0", ("&nbsp;",)), ("&", ("&amp;",))):
        for name in names:
            c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def html_lines(c: Column) -> Column:
    """Text of a page without scripts, styles and comments; every tag begins a line."""
    for tag in ("script", "style", "template"):
        c = F.regexp_replace(c, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", "\n")
    return html_unescape(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", "\n"), r"(?s)<[^>]*>", "\n"))


def sentence_chunks(c: Column, limit: int | None = None, trimmed: bool = True) -> Column:
    """Sentences of all lines of at least MIN_LINE characters, hard-wrapped at MAX_CHUNK; of the first ``limit`` characters
    (MAX_TEXT for documents of the size that the collector takes), or of the whole text. Blanks at the edges of wrapped
    pieces go, unless the pieces are wanted as they were cut."""
    whole, edge = F.coalesce(c, F.lit("")), F.trim if trimmed else lambda x: x
    lines = F.filter(F.transform(F.split(whole if limit is None else F.substring(whole, 1, limit), r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"), normalize_space), lambda x: F.length(x) >= MIN_LINE)
    parts = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, ABBREVIATION, "$1<DOT>"), r"(?<=[.!?])\s+")))
    clean = F.filter(F.transform(parts, lambda x: normalize_space(F.replace(x, F.lit("<DOT>"), F.lit(".")))), lambda x: x != "")
    wrapped = F.flatten(F.transform(clean, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / MAX_CHUNK).cast("int")), lambda i: edge(x.substr(i * MAX_CHUNK + 1, F.lit(MAX_CHUNK))))))
    return F.filter(wrapped, lambda x: x != "")


def clean_title(chunk: Column, number: Column, at: Column) -> Column:
    """The words before a reference at a place, back to the last sentence mark, then its number."""
    before = chunk.substr(F.greatest(at - 180, F.lit(1)), F.least(at - 1, F.lit(180)))
    prefix = F.regexp_replace(normalize_space(F.element_at(F.split(before, "[.!?;]"), -1)), "^[“”\" :–—-]+|[“”\" :–—-]+$", "")
    title = F.trim(F.concat(prefix, F.lit(" Bylaw No. "), number))
    return F.when((at > 0) & F.length(title).between(10, 240), title).otherwise(F.concat(F.lit("Bylaw "), number))


def meeting_title(text: Column, context: Column) -> Column:
    """The published name of a body: date and agenda tails cut from the first candidate that names one."""
    def cleaned(c):
        c = F.regexp_replace(normalize_space(c), r"(?i)\s+(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)?,?\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},\s+[0-9]{4}.*$", "")
        return F.regexp_replace(F.regexp_replace(c, r"(?i)\s+(?:agenda|minutes|video|documents?).*$", ""), "^[ |–—-]+|[ |–—-]+$", "")

    names_body = lambda c: c.rlike("(?i)committee|board|commission|panel|task force|working group|council|public hearing")
    pick = lambda c: F.when(names_body(c) & F.length(cleaned(c)).between(3, 180), cleaned(c))
    return F.coalesce(pick(text), pick(context), first_truthy(normalize_space(text), F.lit("Council meeting")))
