"""Text column functions (P2, P5-P7, P11-P15, P20, P21, P28, P38-P42 of the inventory)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and their plain forms; words that mark folios and bank codes.
ACCENTED, PLAIN = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"
NOISE_WORDS = ["BNET", "BN", "BNTA", "PAY"]
NOISE_CODE = r"^(?:N|ID|FOLIO|REF|OP|TRX)[0-9]{2,}$"
APPROVAL = r"(?i)(autoriza\w*|aprob\w*|firma\w*|liber\w*|palome\w*|oc\b|po\b|orden de compra|licitaci[oó]n|contrato|alta proveedor)"
COMPENSATION = r"(?i)(agradec\w*|detalle|incentiv\w*|bono|regalo|mordida|moche|coima|chayote|por fuera|sin factura|sin cfdi|no timbrar|off the record|favor sexual|salida [ií]ntima|cita privada|trato especial)"
#: The same for texts in lower case, as searches: without endings, by first letters, so that most places in a text are passed at once.
APPROVAL_LOWER = r"(?=[acflop])(?:a(?:utoriza|prob|lta proveedor)|contrato|firma|li(?:ber|citaci[oó]n)|o(?:c\b|rden de compra)|p(?:alome|o\b))"
COMPENSATION_LOWER = r"(?=[abcdfimnoprst])(?:agradec|bono|c(?:oima|hayote|ita privada)|detalle|favor sexual|incentiv|mo(?:rdida|che)|no timbrar|off the record|por fuera|regalo|s(?:in factura|in cfdi|alida [ií]ntima)|trato especial)"
LOAN = r"\b(prestam|adelant|abono)\b"
LOAN_STEMS = r"\b(prestam\w*|adelant\w*|abono\w*)\b"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Trimmed, lower case, without accents, single spaces; null becomes ''."""
    return F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), ACCENTED, PLAIN), r"\s+", " ")


def plain_text(s: str) -> str:
    """normalize() of a parameter."""
    return " ".join(s.strip().lower().translate(str.maketrans(ACCENTED, PLAIN)).split())


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """First column that is neither blank nor 'nan'; '' if none."""
    return F.coalesce(*[F.when(~F.lower(F.trim(c)).isin("", "nan"), F.trim(c)) for c in cols], F.lit(""))


def spanish_ampm(c: Column) -> Column:
    """P2: 'a. m.' and its variants to AM, likewise PM."""
    low = F.regexp_replace(F.trim(c), r"(?i)\ba\.?\s*m\b\.?", "AM")
    return F.regexp_replace(low, r"(?i)\bp\.?\s*m\b\.?", "PM")


#: A text that begins so is read as ISO 8601: T or a space before the time, fractions, Z or an offset.
ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ]|$)"
_N, _YEAR = r"0*\d{1,2}", r"[+-]?\d{4,}"
_CLOCK, _HALF = rf"( {_N}:\d\d(:\d\d(\.\d+)?)?)?$", rf" {_N}:\d\d(:\d\d(\.\d+)?)? [A-Za-z]+$"
#: Other layouts, day first, with parts that may be absent, each with a pattern that all texts match which it can read: an attempt that fails
#: costs many times one that does not. The reference guesses one layout from the first value instead (Q-20).
TIME_FORMATS = (
    ("d/M/yyyy[ H:mm[:ss[.SSSSSS]]]", f"^{_N}/{_N}/{_YEAR}{_CLOCK}"),
    ("d/M/yyyy h:mm[:ss[.SSSSSS]] a", f"^{_N}/{_N}/{_YEAR}{_HALF}"),
    ("d-M-yyyy[ H:mm[:ss[.SSSSSS]]]", f"^{_N}-{_N}-{_YEAR}{_CLOCK}"),
    ("d-M-yyyy h:mm[:ss[.SSSSSS]] a", f"^{_N}-{_N}-{_YEAR}{_HALF}"),
    ("yyyy/M/d[ H:mm[:ss[.SSSSSS]]]", f"^{_YEAR}/{_N}/{_N}{_CLOCK}"),
    ("yyyy-M-d h:mm[:ss[.SSSSSS]] a", f"^{_YEAR}-{_N}-{_N}{_HALF}"),
)

#: Names a step of a function of columns, so that its caller can have it computed once (see Steps); else it is part of what is made of it.
Keep = Callable[[str, Column], Column]


def inlined(name: str, c: Column) -> Column:
    return c


class Steps:
    """Steps of column functions as columns of df, computed once a row: plain columns are written into each of their uses, and into filters
    on them below joins and unions."""

    def __init__(self, df: DataFrame):
        self.df = df

    def keep(self, name: str, c: Column) -> Column:
        self.df = self.df.select("*", F.explode_outer(F.array(c)).alias(f"_{name}"))
        return F.col(f"_{name}")


def parse_time(c: Column, keep: Keep = inlined) -> Column:
    """Timestamp from text; null where no layout fits or the text is blank. A time without an offset is one of the session's zone."""
    text = blank_to_null(keep("time_text", spanish_ampm(c.cast("string"))))
    iso = F.when(text.rlike(ISO), text.try_cast("timestamp"))
    return keep("time", F.coalesce(iso, *[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in TIME_FORMATS]))


def split_list(c: Column) -> Column:
    """Items of a list written with spaces, commas, semicolons, bars or underscores."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;|_]+"), lambda x: x != "")


def parse_description(c: Column, keep: Keep = inlined) -> dict[str, Column]:
    """P5: service, count, id1, id2, detail and code of a free text.

    A trailing operation code is cut off; long words are parted from digits; a leading number is the
    count; the first two words with digits are the ids; what lies before is the service, between (or after) the detail.
    """
    text = keep("squeezed", squeeze(F.regexp_replace(c, " ", " ")))
    code = F.nullif(F.regexp_extract(text, r"([A-Z]{1,2}[0-9]{2})\s*$", 1), F.lit(""))
    rest = F.rtrim(F.regexp_replace(text, r"[A-Z]{1,2}[0-9]{2}\s*$", ""))
    parted = keep("parted", squeeze(F.regexp_replace(rest, r"(?<![0-9])([A-Za-zÁÉÍÓÚÜÑáéíóúüñ.]{3,})([0-9])", "$1 $2")))
    count = F.regexp_extract(parted, r"^([0-9]+)\b\s+", 1)
    body = keep("body", F.trim(F.regexp_replace(parted, r"^[0-9]+\b\s+", "")))
    ids = keep("ids", F.regexp_extract_all(body, F.lit(r"(\b\S*[0-9]\S*\b)"), F.lit(1)))
    id1, id2 = F.get(ids, F.lit(0)), F.get(ids, F.lit(1))
    before = F.substr(body, F.lit(1), F.instr(body, id1) - 1)
    after = keep("after", F.trim(F.substr(body, F.instr(body, id1) + F.length(id1))))
    at2 = F.instr(after, id2)
    detail = F.when(id2.isNull() | (at2 == 0), after).otherwise(F.substr(after, F.lit(1), at2 - 1))
    return {
        "service": F.when(id1.isNull(), blank_to_null(body)).otherwise(blank_to_null(before)),
        "count": F.nullif(count, F.lit("")).try_cast("int"),
        "id1": id1,
        "id2": id2,
        "detail": F.when(id1.isNotNull(), blank_to_null(detail)),
        "code": code,
    }


def compose_description(parts: dict[str, Column], raw: Column) -> Column:
    """Service, detail and code in one text; the raw text where all are empty; blank becomes null."""
    joined = squeeze(F.concat_ws(" ", *[blank_to_null(parts[k]) for k in ("service", "detail", "code")]))
    return F.coalesce(F.nullif(joined, F.lit("")), blank_to_null(raw))


def clean_concept(c: Column) -> Column:
    """Free concept without bank codes and folios; the original if nothing else is left."""
    text = F.coalesce(c, F.lit(""))
    plain = lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    words = F.filter(F.split(F.trim(text), r"[\s,;|/]+"), lambda x: (plain(x) != "") & ~plain(x).isin(NOISE_WORDS) & ~plain(x).rlike(NOISE_CODE))
    kept = F.array_join(words, " ")
    return F.when(F.lower(F.trim(text)).isin("", "nan"), "").when(kept != "", kept).otherwise(text)


def canonical_concept(c: Column) -> Column:
    """Cleaned, lower case, plain letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(clean_concept(c)), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def normalize_reference(c: Column, min_len: int) -> Column:
    """Normalised reference, '' if shorter than min_len."""
    n = normalize(c)
    return F.when(F.length(n) >= min_len, n).otherwise("")


def joined_text(cols: list[Column]) -> Column:
    """P20: non-blank texts with ' | ' between, normalised."""
    return normalize(F.concat_ws(" | ", *[blank_to_null(c) for c in cols]))


def to_bool(c: Column) -> Column:
    """Truth of a text or number in the usual spellings."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "t", "yes", "y", "si", "sí", "verdadero"), F.lit(False))


def split_pair(c: Column) -> Column:
    """The two ids of a pair key."""
    return F.split(c, r"\s*(?:⇄|↔|→|->|\|)\s*")


def forced_concepts(c: Column, known: list[str]) -> Column:
    """The known concepts named in a list-like text ('[a, b]', 'a; b', 'a/b'), in canonical upper case."""
    items = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]'\"]", ""), r"[;,|/]+")
    canon = F.transform(items, lambda x: F.regexp_replace(F.upper(F.translate(F.trim(x), ACCENTED, PLAIN)), "[^A-Z0-9]+", "_"))
    return F.array_intersect(F.array_distinct(canon), F.array(*[F.lit(k) for k in known]))


def as_list(c: Column) -> Column:
    """The different items, in order, of a text that holds a list ('["a", "b"]', "['a', 'b']") or a single item; blank and 'nan' hold none."""
    inside = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^\[(.*)\]$", 1)
    items = F.when(F.trim(c).rlike(r"^\[.*\]$"), F.split(inside, ",")).otherwise(F.array(F.coalesce(c, F.lit(""))))
    plain = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")))
    return F.array_distinct(F.filter(plain, lambda x: ~F.lower(x).isin("", "nan")))


def money(c: Column) -> Column:
    """Amount with two decimals and separators; null as 0."""
    return F.format_number(F.coalesce(c, F.lit(0.0)), 2)


def sentences(*parts: Column) -> Column:
    """The non-null parts with '; ' between."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "; ")


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
