"""Scalar expressions over free text, file names and amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns and bounds that decide results.
STOPWORDS = ("apt", "apartment", "the", "and", "for", "with", "from", "this", "that", "strasse", "str")
ASSOCIATION_KEYWORDS = (
    "hausgeld", "verwaltergebühr", "verwaltergebuehr", "gemeinschaftskosten", "hausverwaltung", "weg", "sonderumlage",
    "instandhaltungsrücklage", "instandhaltungsruecklage", "kontofuehrungsgebuehr", "kontoführungsgebühr", "mahnung",
    "rechnung", "jahresabrechnung", "jahresverbrauch", "jahresverbrauchsabrechnung", "versicherung", "wartungstermin",
    "heizungsraum", "bauamt", "brandschutz", "brandschutznachweis",
)
ASSOCIATION_CATEGORIES = ("hausgeld", "dienstleister", "versorger", "sonstige")
UNIT_ID, TENANT_ID, INVOICE_ID, BUILDING_ID, CONTRACTOR_ID = r"\bEH-\d+\b", r"\bMIE-\d+\b", r"\bINV-\d+\b", r"\bHAUS-\d+\b", r"\bDL-\d+\b"
UNIT_REFERENCE = r"\b(?:EH-\d{2,}|MIE-\d{2,}|WE\s*\d{1,3}|GE\s*\d{1,3})\b"
UNIT_TOKEN = r"\b(?:EH|MIE|WE|GE|TG|HAUS)[-\s]?\d{1,3}\b|\b(?:Apt|Apartment|Wohnung|Whg)\s*\d{1,3}[A-Za-z]?\b"
AUTO_REPLY = r"\b(?:auto[\s-]?reply|out\s+of\s+office|abwesenheit|abwesenheits[a-z]+|automatic[a-z]+)\b"
SIGNATURES = (
    "\n--\n", "\nMit freundlichen Grüßen", "\nFreundliche Grüße", "\nViele Grüße", "\nBeste Grüße", "\nBest regards",
    "\nKind regards", "\nGesendet von", "\nSent from",
)
#: (pattern in the lower-cased file name, label), the first that fits
DOCUMENT_TYPES = (
    (r"(^|[_./-])(rechnung|invoice|inv-)", "invoice"),
    (r"(^|[_./-])mahnung", "mahnung"),
    (r"(^|[_./-])(mietvertrag|lease)(?!_addendum)", "lease"),
    (r"(^|[_./-])(addendum|nachtrag|mietvertrag.*nachtrag)", "lease_addendum"),
    (r"(^|[_./-])(kaufvertrag|sale|deed)", "kaufvertrag"),
    (r"(^|[_./-])(baugenehmigung|permit|structural)", "structural_permit"),
    (r"(^|[_./-])(vermessung|survey|protokoll)", "vermessungsprotokoll"),
)
#: (topic, German words, English words), the first that fits
TOPICS = (
    ("owner_communication", "verkaufsabsicht|sonderumlage|hausverwaltung|eigentuemer|eigentümer|etv|beirat|bescheinigung", "sale[- ]intent|owner[- ]assembly|board[- ]member|certificate"),
    ("tenant_change", "kuendigung|kündigung|mieterwechsel|nachmieter|wohnungsuebergabe|wohnungsübergabe|kaution", "lease[- ]termination|tenant[- ]change|new[- ]tenant|hand[- ]over|deposit[- ]return"),
    ("lease", "mietvertrag|kündigung|kuendigung|verlängerung|verlaengerung|nachmieter|untermiete|mieterwechsel|mietende|wohnungsuebergabe", "lease|tenancy|termination|renewal|sub[- ]let|tenant[- ]change|move[- ]out|hand[- ]over"),
    ("heating", "heiz|heizung|kalt|warmwasser|frost|thermostat|heizungsausfall", "heat|heater|heating|hot[- ]water|cold[- ]radiator|thermostat"),
    ("water", "wasser|leck|tropf|feucht|schimmel|rohr|wasserschaden", "water|leak|drip|moisture|mould|mold|pipe|water[- ]damage"),
    ("key_loss", "schluesselverlust|schlüsselverlust|schließanlage|schliessanlage", "lost[- ]key|key[- ]replacement|locksmith|lock[- ]change"),
    ("window_door", "fenster|tür|tuer|griff|dichtung|jalousie|rolladen", "window|door|handle|seal|blind|shutter"),
    ("compliance", "mietpreisbremse|verordnung|prüfung|abnahme|brandschutz|modernisierung|baugenehmigung|brandschutznachweis", "regulation|inspection|approval|fire[- ]safety|modernization|building[- ]permit"),
    ("complaint", "beschwerde|reklamation|störung|stoerung|defekt|mängel|maengel", "complaint|defect|malfunction|disturbance"),
    ("payment", "miete|kaltmiete|nebenkosten|nebenkostenabrechnung|zahlung|lastschrift|säumig|kaution|hausgeld", "rent|payment|deposit|overdue|invoice|wire[- ]transfer|sepa"),
)
#: topic: (category, priority, section, field)
TOPIC_FACTS = {
    "heating": ("maintenance", "high", "maintenance", "open_heating_issue"),
    "water": ("maintenance", "urgent", "maintenance", "open_water_leak"),
    "key_loss": ("maintenance", "medium", "maintenance", "key_lost"),
    "window_door": ("maintenance", "medium", "maintenance", "defective_window"),
    "lease": ("lease", "medium", "lease", "renewal_discussion"),
    "tenant_change": ("tenant_change", "medium", "lease", "termination_notice"),
    "payment": ("payment", "medium", "financials", "payment_mention"),
    "owner_communication": ("owner_communication", "medium", "overview", "sale_intent"),
    "complaint": ("maintenance", "medium", "maintenance", "noise_complaint"),
    "compliance": ("compliance", "medium", "compliance", "regulatory_mention"),
}
#: Frequent words by language; a text's language has most of them, the first of equals.
LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "was", "with", "be", "on", "this", "are"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "zu", "mit", "von", "für", "auf", "den", "im", "sich", "des"),
    "nl": ("het", "een", "van", "niet", "dat", "op", "te", "voor", "met", "zijn", "aan", "wij"),
    "fr": ("le", "la", "les", "et", "des", "est", "une", "que", "pour", "dans", "du", "pas", "avec"),
    "es": ("el", "los", "las", "y", "que", "en", "una", "por", "con", "para", "se", "del", "como"),
}
LEAST_CHARS = 30
ACTIVE_DAYS, RECENT_DAYS = 90, 365
SHORT_BODY = 50


def first_label(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The label of the first rule that holds."""
    out = F.when(*_pair(rules[0]))
    for rule in rules[1:]:
        out = out.when(*_pair(rule))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def _pair(rule: tuple[Column, object]) -> tuple[Column, Column]:
    condition, label = rule
    return condition, label if isinstance(label, Column) else F.lit(label)


def any_word(words: Sequence[str] | str) -> str:
    """A pattern for any of the words as whole words, in either case."""
    return r"(?iu)\b(?:" + (words if isinstance(words, str) else "|".join(words)) + r")\b"


def tokens(col: Column) -> Column:
    """Distinct lower-case tokens of two or more letters or digits, without STOPWORDS."""
    found = F.transform(F.regexp_extract_all(col, F.lit("([A-Za-zÄÖÜäöüß0-9]{2,})"), F.lit(1)), F.lower)
    return F.array_distinct(F.array_except(found, F.array(*map(F.lit, STOPWORDS))))


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """What the pattern finds first, or null."""
    found = F.regexp_extract(col, pattern, group)
    return F.when(found != "", found)


def amount(col: Column) -> Column:
    """A decimal with comma or point; null where it isn't one (also with both)."""
    return F.regexp_replace(F.trim(col), ",", ".").try_cast("decimal(18,2)")


def first_number(col: Column) -> Column:
    """The first number in a text, comma or point before the decimals."""
    return F.regexp_replace(first_match(col, r"\d+(?:[.,]\d+)?"), ",", ".").try_cast("double")


def first_iso_date(col: Column) -> Column:
    """The first 20yy-mm-dd in a text, null where it isn't a date."""
    return F.try_to_date(first_match(col, r"20\d{2}-\d{2}-\d{2}"), "yyyy-MM-dd")


def document_type(col: Column) -> Column:
    """The kind of document that a file name tells."""
    name = F.lower(col)
    return first_label([(name.rlike(p), label) for p, label in DOCUMENT_TYPES], "other")


def topic(col: Column, lang: Column) -> Column:
    """The first topic with a word in the text, in German or English; null without one."""
    return first_label([(col.rlike(any_word(f"{de}|{en}")), name) for name, de, en in TOPICS])


def _count_in(words: Column, known: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def raw_language(col: Column) -> Column:
    """The language whose frequent words a text has most of; unknown for a short text or one without any."""
    split = F.split(F.regexp_replace(F.lower(col), r"[\s.,;:!?()\"]+", " "), " ")
    names = F.array(*map(F.lit, LANGUAGE_WORDS))
    # each value is bound once: a text is split once, and counted once for each language
    counts = F.transform(F.array(split), lambda words: F.array(*(_count_in(words, own) for own in LANGUAGE_WORDS.values())))
    best = F.transform(counts, lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))))
    return F.when(F.coalesce(F.length(F.trim(col)), F.lit(0)) < LEAST_CHARS, "unknown").otherwise(F.coalesce(best.getItem(0), F.lit("unknown")))


def language(col: Column) -> Column:
    """de for German and its neighbours, en for all else."""
    return draft_language(raw_language(col))


def draft_language(raw: Column) -> Column:
    return F.when(raw.isin("de", "nl", "af"), "de").otherwise("en")


def strip_signature(col: Column) -> Column:
    """The text before the first signature mark, trimmed."""
    ends = [F.nullif(F.instr(col, m), F.lit(0)) for m in SIGNATURES]
    return F.regexp_replace(F.substring(col, F.lit(1), F.coalesce(F.least(*ends) - 1, F.length(col))), r"^\s+|\s+$", "")


def unrouted_reason(body: Column, subject: Column, sender: Column, lang: Column, known_domains: Column) -> Column:
    """Why an event found no property, the first reason that holds. ``known_domains``: an array."""
    text, domain = strip_signature(body), F.lower(first_match(sender, r"@([\w.-]+)", 1))
    auto = any_word(AUTO_REPLY.removeprefix(r"\b(?:").removesuffix(r")\b"))
    return first_label([
        (F.length(text) < SHORT_BODY, "body_too_short"),
        (F.coalesce(subject, F.lit("")).rlike(auto) | text.rlike(auto), "auto_reply"),
        (~F.coalesce(lang, F.lit("unknown")).isin("de", "en", "nl", "af", "unknown"), F.concat(F.lit("non_de_en_language_"), lang)),
        (body.rlike(any_word(ASSOCIATION_KEYWORDS)), "weg_keyword_no_liegenschaft"),
        (body.rlike("(?iu)" + UNIT_TOKEN), "property_tokens_no_alias_match"),
        (domain.isNotNull() & ~F.array_contains(known_domains, domain), "unknown_sender_domain"),
        (domain.isNotNull(), "no_signal_known_sender"),
    ], "no_signal")


def truncated(col: Column, limit: int) -> Column:
    """White space collapsed; an ellipsis in place of what is over the limit."""
    flat = F.trim(F.regexp_replace(col, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def sentence_case(col: Column) -> Column:
    words = F.replace(col, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


def comparable(col: Column) -> Column:
    """Lower case, trimmed, without a trailing .0."""
    return F.regexp_replace(F.lower(F.trim(col)), r"\.0$", "")


def age_tier(at: Column, as_of: Column) -> Column:
    """active, recent or archive by exact age; active without a time."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    day = 86_400_000_000
    return first_label([(age.isNull() | (age <= ACTIVE_DAYS * day), "active"), (age <= RECENT_DAYS * day, "recent")], "archive")


def hash_key(*cols: Column, size: int = 12) -> Column:
    """The first hex digits of the SHA-256 of the columns, joined by bars; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256), 1, size)


def severity_rank(col: Column) -> Column:
    return first_label([(col == s, i) for i, s in enumerate(("urgent", "high", "medium", "low"))], 4)
