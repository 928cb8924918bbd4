"""Text analysis: char filters, tokenizers and token filters put together into named analyzers, and identifier normalisers."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that the loader treats as missing (fixed values).
NA_VALUES = ["", "NA", "N/A", "n/a", "NULL", "null", "None", "nan", "NaN", "-nan", "-NaN", "#N/A", "#N/A N/A", "#NA", "<NA>", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN"]

#: Company words, unit designators, hospital words and street suffixes that analysis removes or contracts (fixed values).
COMPANY_STOP = "llc inc ltd co corp corporation company trucking truck transport transportation express logistics carrier carriers enterprises enterprise services service group freight hauling the".split()
UNIT_STOP = "ste suite apt apartment unit rm room bldg fl floor trlr lot sp spc pmb dept department hngr ofc".split()
HOSPITAL_STOP = "hospital hospitals center centre medical health healthcare memorial regional community general system systems behavioral county university clinic care of and the inc llc lp corp".split()
STREET_CANON = {
    "street": "st str strt", "avenue": "ave av aven avenu avn", "road": "rd", "boulevard": "blvd boul boulv", "drive": "dr drv driv", "lane": "ln",
    "highway": "hwy hiway highwy hway", "parkway": "pkwy pky parkwy pkway", "court": "ct crt", "circle": "cir circ circl crcl", "place": "pl", "terrace": "ter terr",
    "square": "sq sqr squ", "trail": "trl tr", "expressway": "expy expwy expr", "turnpike": "tpke trnpk turnpk", "freeway": "frwy fwy freewy", "route": "rte rt",
    "bypass": "byp bypa bypas", "extension": "ext extn", "lake": "lk", "mount": "mt mnt", "point": "pt", "ridge": "rdg rdge", "spring": "spg spng sprng",
    "valley": "vly vlly", "crossing": "xing crssng", "plaza": "plz plza", "center": "ctr cen cent centre", "north": "n no nth", "south": "s so sth", "east": "e ea",
    "west": "w we", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}

PO_BOX = r"(?i)\bp[.\s]*o[.\s]*(box|b\b)"
#: Words as Unicode segments them: letters and digits, with . ' : between letters, and . , ; ' between digits.
STANDARD = r"(?:[\p{L}\p{M}\p{N}_]|(?<=\p{L})[.':’](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))+"


#: Letters that have no accent to strip but a plain form in the folding table (fixed values).
PLAIN_LETTERS = (("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ħ", "h"), ("ı", "i"), ("ŋ", "n"), ("ŧ", "t"))


def fold(c: Column) -> Column:
    """Compatibility forms composed (NFKC), case folded in full, diacritics off."""
    call = lambda owner, method, *args: F.call_function("java_method", F.lit(owner), F.lit(method), *args)
    composed = call("com.ibm.icu.text.Normalizer", "compose", F.coalesce(c, F.lit("")), F.lit(True))
    folded = call("com.ibm.icu.lang.UCharacter", "foldCase", composed, F.lit(True))
    plain = call("org.apache.commons.lang3.StringUtils", "stripAccents", folded)
    for old, new in PLAIN_LETTERS:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.when(c.isNotNull(), plain)


@dataclass(frozen=True)
class Analyzer:
    """A declarative analyzer; ``tokens`` compiles it to a Column of ARRAY<STRING> with repeats."""

    tokenizer: str = "standard"
    po_box: bool = False
    folded: bool = True
    punct_to_space: bool = True
    digits_only: bool = False
    stop: tuple[str, ...] = ()
    contract: tuple[tuple[str, str], ...] = ()
    phonetic: str | None = None

    def tokens(self, c: Column) -> Column:
        """Tokens before phonetic encoding (which works on distinct tokens; see ``phonetic``)."""
        text = c.cast("string")
        if self.po_box:
            text = F.regexp_replace(text, PO_BOX, "pobox")
        if self.folded:
            text = fold(text)
        if self.digits_only:
            text = F.regexp_replace(text, r"[^\d]", "")
        if self.tokenizer == "keyword":
            if self.punct_to_space:
                text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Punct}", " "), r"\s+", " "))
            return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STANDARD), F.lit(0))
        if self.punct_to_space:
            found = F.transform(found, lambda t: F.regexp_replace(t, r"\p{Punct}", " "))
        if self.stop:
            found = F.filter(found, lambda t: ~t.isin(list(self.stop)))
        if self.contract:
            table = F.create_map(*[F.lit(x) for pair in self.contract for x in pair])
            found = F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), t))
        return F.filter(found, lambda t: F.trim(t) != "")

    def token_set(self, c: Column) -> Column:
        return F.array_distinct(self.tokens(c))


_STREETS = tuple((short, full) for full, shorts in STREET_CANON.items() for short in shorts.split())

ANALYZERS = {
    "name_clean": Analyzer(),
    "name_phonetic": Analyzer(stop=tuple(COMPANY_STOP), phonetic="double_metaphone"),
    "name_phonetic_bm": Analyzer(stop=tuple(COMPANY_STOP), phonetic="beider_morse"),
    "street_clean": Analyzer(tokenizer="keyword", po_box=True),
    "street_tokens": Analyzer(po_box=True, stop=tuple(UNIT_STOP), contract=_STREETS),
    "phone_clean": Analyzer(tokenizer="keyword", folded=False, punct_to_space=False, digits_only=True),
    "hospital_clean": Analyzer(stop=tuple(HOSPITAL_STOP)),
    "hospital_phonetic": Analyzer(stop=tuple(HOSPITAL_STOP), phonetic="metaphone"),
}


@dataclass(frozen=True)
class Binding:
    """Which analyzers a field is analyzed by: {subfield: analyzer}."""

    field: str
    subfields: dict[str, str] = field(default_factory=dict)


def fingerprint(analyzers: dict[str, Analyzer], bindings: list[Binding]) -> str | None:
    """First 16 hex digits of the SHA-256 of all that decides tokens; None when nothing is analyzed."""
    if not analyzers and not any(b.subfields for b in bindings):
        return None
    spec = {"analyzers": {n: a.__dict__ for n, a in sorted(analyzers.items())}, "bindings": {b.field: dict(sorted(b.subfields.items())) for b in sorted(bindings, key=lambda b: b.field)}}
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=list).encode()).hexdigest()[:16]


def normalize_phone(c: Column) -> Column:
    """Digits only; NULL for fewer than seven or one digit repeated."""
    d = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.when((F.length(d) >= 7) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != ""), d)


def normalize_text(c: Column) -> Column:
    """Trimmed and lower-cased; NULL when blank."""
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def normalize_join_key(c: Column) -> Column:
    """Numbers as they compare in a join: cut at the first dot, leading zeros gone; anything else stays as it is."""
    head = F.substring_index(c, ".", 1)
    number = F.when(head.rlike(r"^[+-]?\d+$"), head.try_cast("bigint"))
    return F.coalesce(number.cast("string"), c)


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_VALUES), c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")
