"""Column expressions: normalisation, matching, anchoring, screening and display text.

All of them are compositions of built-in functions, so they run inside generated code. The one exception is
Unicode NFKC folding, which Spark has no function for; it is an Arrow UDF that only receives non-ASCII values.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------- names and identifiers


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_name(c) -> Column:
    """Lower case, every run of characters outside a-z0-9 becomes one space."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "))


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose caseless form is not their lower-case one: those with a form of one character, and of several.

    Follows from the rules of Unicode as Python has them, on all characters up to the last one with a case.
    """
    one, many = {}, {}
    for code in range(0x80, 0x1F000):
        c = chr(code)
        folded = c.casefold()
        if folded != c and c.lower() == c:
            (one if len(folded) == 1 else many)[c] = folded
    return one, many


_ONE, _MANY = _foldings()


def casefolded(c) -> Column:
    """Caseless form, all in the JVM: lower case, then the characters for which that is not enough."""
    c = _c(c)
    lower = F.lower(c)
    folded = F.translate(lower, "".join(_ONE), "".join(_ONE.values()))
    spelt = F.create_map(*[F.lit(x) for pair in _MANY.items() for x in pair])
    longer = F.array_join(F.transform(F.split(folded, ""), lambda x: F.coalesce(F.element_at(spelt, x), x)), "")
    whole = F.when(F.rlike(folded, F.lit(f"[{''.join(_MANY)}]")), longer).otherwise(folded)
    return F.when(F.length(c) == F.octet_length(c), lower).otherwise(whole)


def is_blank(c) -> Column:
    """Nothing but white space of any kind."""
    return F.regexp_replace(_c(c), r"(?U)[\s\x1c-\x1f]", "") == ""


def norm_mention(c) -> Column:
    """Caseless with single spaces; punctuation stays, so that variant notations never collapse."""
    return F.trim(F.regexp_replace(casefolded(c), r"(?U)[\s\x1c-\x1f]+", " "))


def norm_xref(c) -> Column:
    c = _c(c)
    return F.when(F.lower(c).startswith("orphanet:"), F.concat(F.lit("ORPHA:"), F.substr(c, F.lit(10)))).otherwise(c)


def slug(c) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def curie(c) -> Column:
    """``.../HP_0001250`` -> ``HP:0001250``; null when the tail is not prefix_number."""
    tail = F.substring_index(_c(c), "/", -1)
    return F.when(tail.rlike("^[A-Za-z]+_[A-Za-z0-9]+$"), F.replace(tail, F.lit("_"), F.lit(":")))


def unpadded(c) -> Column:
    """Identifier without surrounding blanks and leading zeros."""
    return F.ltrim(F.trim(_c(c)), F.lit("0"))


def nonempty(c) -> Column:
    """Null for the empty string, as a missing value in fallback chains."""
    return F.nullif(_c(c), F.lit(""))


def title_case(c) -> Column:
    """Upper-cases the first letter of every run of letters (also after hyphen and apostrophe)."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def clean_text(c) -> Column:
    """The replacement character stands for an en dash in archived pages."""
    return F.replace(_c(c), F.lit("�"), F.lit("–"))


def decode_obfuscated(c) -> Column:
    """Protected e-mail text: hex bytes, the first one is the XOR key of the rest; anything malformed is empty."""
    c = _c(c)
    byte = lambda pos: F.conv(F.substring(c, pos, F.lit(2)), 16, 10).cast("int")
    decoded = F.array_join(
        F.transform(
            F.sequence(F.lit(3), F.greatest(F.length(c), F.lit(3)), F.lit(2)),
            lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1)))),
        ), "")
    return F.when((F.length(c) >= 4) & (F.length(c) % 2 == 0) & c.rlike("^[0-9a-fA-F]+$"), decoded).otherwise(F.lit(""))


def _code_point(number: Column) -> Column:
    return F.when(
        (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF),
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
    ).otherwise(F.lit("\ufffd"))


def unescape_html(c) -> Column:
    """Named, decimal and hexadecimal entities decoded in one pass; unknown ones stay as they are."""
    names = F.from_json(F.lit(json.dumps({f"&{k};": chr(v) for k, v in name2codepoint.items()} | {"&apos;": "'"})), "map<string,string>")

    def decoded(part: Column) -> Column:
        number = F.when(part.rlike("^&#[xX]"), F.conv(F.regexp_extract(part, "([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(part, "([0-9]+);$", 1))
        return (
            F.when(part.rlike("^&#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,8});$"), _code_point(number.cast("bigint")))
            .when(part.rlike("^&[A-Za-z0-9]+;$"), F.coalesce(F.try_element_at(names, part), part)).otherwise(part)
        )

    c = _c(c)
    parts = F.regexp_extract_all(c, F.lit("(&#?[A-Za-z0-9]+;|[^&]+|&)"), 1)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def strip_tags(c) -> Column:
    """The text of a fragment: tags off, then entities decoded."""
    return F.trim(unescape_html(F.regexp_replace(_c(c), r"(?s)<[^>]+>", "")))


# ---------------------------------------------------------------- matching


def whole_word(text, word, ignore_case: bool = False) -> Column:
    """``word`` (a column) occurs in ``text`` between word boundaries, taken literally."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    return F.rlike(_c(text), F.concat(F.lit(flags + r"\b\Q"), _c(word), F.lit(r"\E\b")))


def specific_terms(name, synonyms) -> Column:
    """Name, then the synonyms of at least six characters that are not all upper case; first spelling of each."""
    # a synonym counts as all upper case when it has a cased letter and upper-casing changes nothing
    usable = F.filter(
        F.coalesce(_c(synonyms), F.array().cast("array<string>")),
        lambda s: (F.length(s) >= 6) & ~((s == F.upper(s)) & (s != F.lower(s))),
    )
    terms = F.concat(F.array(_c(name)), usable)
    return F.filter(terms, lambda t, i: F.array_position(F.transform(terms, F.lower), F.lower(t)) == i + 1)


def match_reason(texts, terms, gene) -> Column:
    """Why a record belongs to an entity: the first term contained in its texts, else the gene as a whole word."""
    blob = F.lower(F.array_join(_c(texts), " | "))
    hit = F.get(F.filter(_c(terms), lambda t: F.contains(blob, F.lower(t))), F.lit(0))
    return F.coalesce(
        F.concat(F.lit("lists “"), hit, F.lit("”")),
        F.when(F.length(_c(gene)) > 0, F.when(whole_word(blob, F.lower(_c(gene))), F.concat(F.lit("mentions the gene "), _c(gene)))),
    )


def first_xref(xrefs, *prefixes: str) -> Column:
    """Local part of the first cross reference with one of the prefixes (any case)."""
    ok = lambda x: F.substring_index(F.lower(x), ":", 1).isin(*[p.lower() for p in prefixes])
    return F.regexp_extract(F.get(F.filter(_c(xrefs), lambda x: ok(x) & F.contains(x, F.lit(":"))), F.lit(0)), "^[^:]*:(.*)$", 1)


# Words that describe dose, formulation or arm instead of the tested substance.
FORMULATION_WORDS = ("oral solution|tablets?|capsules?|injection|syrup|suspension|treatment|therapy arm|"
                     "cohort|dose escalation|low dose|high dose|adjunctive")
DRUG_TYPES = ["DRUG", "BIOLOGICAL", "GENETIC", "COMBINATION_PRODUCT", "DIETARY_SUPPLEMENT"]
CONTROL_ARM = "(?i)placebo|vehicle|sham|standard of care|usual care"


def norm_intervention(c) -> Column:
    """Display name of a tested substance without dose, formulation, arm or cohort wording."""
    head = F.regexp_extract(_c(c), "(?s)^(.*?)(?:\\s*[-‐-—]\\s*(?=[A-Z])|\\s+[-–]\\s+|:|,|$)", 1)
    out = F.regexp_replace(head, r"(?i)\(.*?\)|\b\d+(\.\d+)?\s*(mg|ml|mg/kg|%)\b.*", "")
    out = F.regexp_replace(out, rf"(?i)\b({FORMULATION_WORDS})\b", "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" -,"))


def intervention_label(c) -> Column:
    """Upper-cases the first letter of names written all in lower case."""
    c = norm_intervention(c)
    lower = (c == F.lower(c)) & (c != F.upper(c))
    return F.when(lower, F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))).otherwise(c)


def review_stars(c) -> Column:
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    return (
        F.when(s.contains("practice guideline"), 4)
        .when(s.contains("expert panel"), 3)
        .when(s.contains("multiple submitters, no conflicts"), 2)
        .when(s.contains("single submitter") | s.contains("conflicting"), 1)
        .otherwise(0)
    )


# Organisation focus classes, first match wins.
ORG_FOCUS = [
    ("Disease-specific", r"grin|cdkl5|stxbp1|dravet|scn\d|rett|syngap|neurotransmi"),
    ("Epilepsy", r"epilep|epiless|epilepsi|sudep|seizure"),
    ("Autism", r"autis|asperger"),
    ("Rare diseases (general)", r"rare|raras|rares|seltene|harvinai|alliance|alianza|genetic|orphan"),
]
DEFAULT_FOCUS = "Children & disability"


def org_focus(c) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(ORG_FOCUS):
        out = F.when(F.rlike(_c(c), F.lit("(?i)" + pattern)), F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_FOCUS))


# ---------------------------------------------------------------- evidence


def first_at(text, quote) -> Column:
    """0-based code-point offset of the first occurrence, -1 when there is none."""
    return F.instr(_c(text), _c(quote)) - 1


def span_problem(text, quote) -> Column:
    """Null when the quote stands exactly once in the text, else the reason."""
    text, quote = _c(text), _c(quote)
    first = F.instr(text, quote)
    again = F.instr(F.substr(text, F.greatest(first, F.lit(0)) + 1), quote)  # overlapping repeats count too
    return (
        F.when(F.trim(F.coalesce(F.regexp_replace(quote, r"(?U)\s", ""), F.lit(""))) == "", F.lit("empty evidence"))
        .when(first == 0, F.lit("quote not found verbatim"))
        .when(again > 0, F.lit("ambiguous quote location; longer evidence required"))
    )


def span(text, quote, offset=0) -> Column:
    """Half-open span of an anchored quote, shifted by the offset of its chunk."""
    start = first_at(text, quote) + (F.lit(offset) if isinstance(offset, int) else _c(offset))
    return F.struct(_c(quote).alias("quote"), start.alias("start"), (start + F.length(_c(quote))).alias("end"))


def content_digest(*cols) -> Column:
    """SHA-256 of the named values in sorted name order, as canonical JSON."""
    named = sorted(cols)
    return F.sha2(F.to_json(F.struct(*named)), 256)


# Screening patterns (case-insensitive, `.` excludes only the newline).
SCREENING = {
    "instruction_override": r"\b(?:ignore|disregard|override)\b.{0,60}\b(?:instructions?|prompts?|rules?|system)\b",
    "role_spoofing": r"<\|(?:im_start|im_end|system|assistant)|\[INST\]|(?:^|\n)\s*(?:system|developer)\s*:",
    "approval_spoofing": r"\b(?:skip|bypass|disable)\b.{0,60}\b(?:review|verification|guardrails?|approval)\b",
    "secret_request": r"\b(?:reveal|print|send|exfiltrate|upload)\b.{0,80}\b(?:api.?key|secret|password|environment variable|system prompt)\b",
    "active_markup": r"<\s*(?:script|iframe|object|embed)\b|javascript\s*:",
}
HIDDEN = r"[\p{Cf}\p{Cs}[\p{Cc}&&[^\n\r\t]]]"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def folded(c) -> Column:
    """NFKC form. ASCII text is its own form and is passed to the UDF as null, so only other text crosses to Python."""
    c = _c(c)
    return F.coalesce(_nfkc(F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), c)), c)


def screening_flags(raw, normal) -> Column:
    """Sorted flags of one text; ``normal`` is its NFKC form, hidden characters are looked for in the raw text."""
    found = [F.when(F.rlike(_c(normal), F.lit("(?idU)" + p)), F.lit(name)) for name, p in SCREENING.items()]
    found.append(F.when(F.rlike(_c(raw), F.lit(HIDDEN)), F.lit("hidden_or_control_characters")))
    return F.array_sort(F.array_compact(F.array(*found)))


# ---------------------------------------------------------------- display


def strength_label(score) -> Column:
    return F.when(_c(score) >= 30, "strong").when(_c(score) >= 24, "moderate").otherwise("weak")


def clip(c, n: int) -> Column:
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…"))).otherwise(c)


def node_label(node_type, name, short, synonyms, protein_change, cdna_change) -> Column:
    """Short label of a node bubble."""
    t, name, short = _c(node_type), _c(name), nonempty(short)
    abbr = F.get(F.filter(_c(synonyms), lambda s: s.rlike("^[A-Z0-9-]{3,10}$")), F.lit(0))
    disease = (
        F.when(F.length(name) <= 22, name)
        .when(short.isNotNull() & abbr.isNotNull(), F.concat_ws(" · ", short, abbr))
        .when(short.isNotNull(), F.concat(short, F.lit("-related")))
        .otherwise(F.concat(F.left(name, F.lit(22)), F.lit("…")))
    )
    return (
        F.when(t == "Variant", F.coalesce(nonempty(protein_change), nonempty(cdna_change), name))
        .when(t == "Disease", disease)
        .when(t.isin("Paper", "Study", "Grant"), clip(name, 34))
        .when(t == "GeneGroup", clip(F.regexp_replace(name, "^Glutamate ionotropic receptor ", ""), 30))
        .when(t == "Claim", clip(name, 40))
        .otherwise(name)
    )


def external_links(node_type, node_id, xrefs, hgnc_id, entrez_id, url, nord_url) -> Column:
    """Outbound links as an array of (label, url)."""
    t, i, u = _c(node_type), _c(node_id), _c(url)
    link = lambda label, *parts: F.struct(F.lit(label).alias("label"), F.concat(*parts).alias("url"))
    when = lambda cond, label, *parts: F.when(cond, link(label, *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    cross = F.transform(F.coalesce(_c(xrefs), F.array().cast("array<string>")), lambda x: F.coalesce(
        when(F.substring_index(x, ":", 1) == "OMIM", "OMIM", "https://omim.org/entry/", F.split_part(x, F.lit(":"), F.lit(2))),
        when(F.substring_index(x, ":", 1) == "MEDGEN", "MedGen", "https://www.ncbi.nlm.nih.gov/medgen/", F.split_part(x, F.lit(":"), F.lit(2))),
        when(F.substring_index(x, ":", 1) == "DOID", "Disease Ontology", "https://disease-ontology.org/?id=", x),
        when(F.substring_index(x, ":", 1).isin("ORPHA", "Orphanet"), "Orphanet", "https://www.orpha.net/en/disease/detail/", F.split_part(x, F.lit(":"), F.lit(2))),
    ))
    has = lambda c: nonempty(c).isNotNull()
    number = F.regexp_extract(i, r"VCV0*(\d+)", 1)
    org = t.isin("PatientOrg", "Registry")
    fixed = F.array(
        when(t == "Gene", "HGNC", "https://www.genenames.org/data/gene-symbol-report/#!/hgnc_id/", nonempty(hgnc_id)),
        when(t == "Gene", "NCBI Gene", "https://www.ncbi.nlm.nih.gov/gene/", nonempty(entrez_id)),
        when((t == "Variant") & i.rlike(r"^(CLINVAR:)?VCV\d+"), "ClinVar", "https://www.ncbi.nlm.nih.gov/clinvar/variation/", number, "/"),
        when(t == "Phenotype", "HPO", "https://hpo.jax.org/browse/term/", i),
        when((t == "Paper") & i.startswith("PMID:"), "PubMed", "https://pubmed.ncbi.nlm.nih.gov/", F.substr(i, F.lit(6)), "/"),
        when(org, "Website", nonempty(u)),
        when(org & ~(_c(nord_url).eqNullSafe(u)), "NORD profile", nonempty(nord_url)),
        when(t == "Study", "ClinicalTrials.gov", nonempty(u)),
        when(t == "Grant", "NIH RePORTER", nonempty(u)),
        when(t == "GeneGroup", "HGNC gene group", nonempty(u)),
    )
    own = F.when(t == "Disease", F.concat(F.array(link("MONDO", F.lit("https://monarchinitiative.org/"), i)), cross)).otherwise(fixed)
    return F.filter(F.array_compact(own), lambda x: x["url"].isNotNull())
