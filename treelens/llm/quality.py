"""Line-first quality rules.

Each line is judged on its own: punctuation (symbols or shouting strewn over its words), navigation
(words set apart by menu bars) and boilerplate (phrases of web furniture in English, German, Spanish and French). Lines that fail go, and
a document that loses too much of its text with them is rejected. Base counts over the whole text
(words, symbols, repeated lines, repeated 8-word windows) reject a document before that.

DataFrame functions only, one row in and one row out, no shuffle. Defined results: a null or
blank text has no words, zero counts, and fails; lines without a word are kept and weigh nothing; long
texts and lines are judged whole; repeated rows are judged alike; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.llm.common import GAP, pick

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT, SYMBOLS = 20, 8, 30, "#*$%&|<>"
#: Percent of a line's words that may carry strewn symbols or shouting; stand as menu bars; of a document's words that may go with its lines.
MAX_STREWN, MAX_BARS, MAX_LOST = 20, 15, 50
#: Web furniture, lower case, by the word or two that each phrase of the group holds: a text without any of these words has none.
BOILERPLATE = {
    "cookie": ["accept all cookies", "use of cookies", "we use cookies", "cookie policy", "cookie settings", "alle cookies akzeptieren", "verwendet cookies", "cookie-einstellungen", "aceptar todas las cookies", "uso de cookies", "accepter tous les cookies", "utilise des cookies", "gestion des cookies"],
    "javascript": ["enable javascript", "javascript is disabled", "javascript aktivieren", "activar javascript", "active javascript", "activer javascript", "activez javascript"],
    "newsletter": ["sign up for our newsletter", "subscribe to our newsletter", "newsletter abonnieren", "zum newsletter anmelden", "inscrivez-vous à notre newsletter"],
    "boletín": ["suscríbete a nuestro boletín", "suscríbase a nuestro boletín"],
    "rights reserved": ["all rights reserved"], "rechte vorbehalten": ["alle rechte vorbehalten"], "derechos reservados": ["todos los derechos reservados"], "droits réservés": ["tous droits réservés"],
    "policy": ["privacy policy"], "datenschutz": ["datenschutzerklärung"], "privacidad": ["política de privacidad"], "confidentialité": ["politique de confidentialité"],
    "terms of": ["terms of use", "terms of service"], "nutzungsbedingungen": ["nutzungsbedingungen"], "condiciones de uso": ["condiciones de uso"], "conditions d'utilisation": ["conditions d'utilisation"],
    "lorem ipsum": ["lorem ipsum"], "click here": ["click here to"], "klicken sie hier": ["klicken sie hier"], "haga clic": ["haga clic aquí"], "cliquez ici": ["cliquez ici"],
    "skip to": ["skip to content", "skip to main content"], "zum inhalt": ["zum inhalt springen"], "saltar al": ["saltar al contenido"], "aller au": ["aller au contenu"],
    "back to top": ["back to top"], "nach oben": ["zurück nach oben"], "volver arriba": ["volver arriba"], "haut de page": ["haut de page"],
}
_STREWN = r"(?:[#*$%&<>]{2,}|!{2,})(?=[\x20\x09-\x0D]|$)"
_BAR = r"(?:^|[\x20\x09-\x0D])[|>»](?=[\x20\x09-\x0D]|$)"


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once instead of in each turn of body's lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _runs(hashes: Column, n: int) -> Column:
    """The hash of every run of n members: of two runs of half as many, or of one member fewer and one; what is past the end is cut off by the caller."""
    if n == 1:
        return hashes
    most = n - n % 2
    joined = lambda h, other, skip: F.zip_with(h, F.slice(other, skip + 1, F.greatest(F.size(other) - skip, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    even = _bind(_runs(hashes, most // 2), lambda h: joined(h, h, most // 2))
    return even if most == n else joined(even, hashes, most)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that the text holds twice or more.

    Windows are sorted by hash with their places, so that equal ones stand together; the places
    of those with an equal neighbour, sorted again, cover min(window, distance to the next) words each.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def of(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        twice = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        places = _bind(tagged, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["at"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(places, covered))

    def windows(hashes: Column) -> Column:
        return F.slice(_runs(hashes, window), 1, F.size(hashes) - window + 1)

    none = F.lit(0).cast("long")
    return _bind(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) < window, none).otherwise(_bind(windows(h), of)))


def _strewn(line: Column) -> Column:
    """Symbols strewn over a line's words, or menu bars between them."""
    n = F.greatest(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1))
    strewn = line.rlike(_STREWN) & (F.regexp_count(line, F.lit(_STREWN)) * 100 > n * MAX_STREWN)
    return strewn | (line.rlike(_BAR) & (F.regexp_count(line, F.lit(_BAR)) * 100 > n * MAX_BARS))


def _furniture(line: Column) -> Column:
    return F.lower(line).rlike("|".join(phrase for group in BOILERPLATE.values() for phrase in group))


def line_fails(line: Column) -> Column:
    return _strewn(line) | _furniture(line)


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def clean(text: Column, judge: Column) -> Column:
    """text without the lines that fail, where judge holds; lines are only looked at in a text that holds a sign or word that some rule needs."""
    keep = lambda fails: F.array_join(F.filter(F.split(text, "\n"), lambda x: ~fails(x)), "\n")
    signs, words = _any(text, [*"#*$%&<>|»", "!!"]), _any(F.lower(text), list(BOILERPLATE))
    return F.when(judge & words, keep(line_fails)).when(judge & signs, keep(_strewn)).otherwise(text)


def judged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the base counts, the verdict, and the cleaned text of those that pass the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    lines = F.filter(F.split(text, "\n"), with_word)
    n_symbols = sum((F.length(text) - F.length(F.replace(text, F.lit(c))) for c in SYMBOLS), F.lit(0))
    counted = docs.select(
        "*",
        _bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("__w"),
        n_symbols.cast("long").alias("n_symbols"),
        _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    based = counted.select("*", "__w.*").drop("__w").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT))
    cleaned = based.withColumn("clean_text", clean(text, ~F.col("base_failed")))
    left = F.when(F.col("clean_text") == F.col("text"), F.col("n_words")).otherwise(F.size(words_of(F.col("clean_text"))).cast("long"))
    judged_ = cleaned.withColumn("n_words_left", F.when(F.col("base_failed"), F.lit(None).cast("long")).otherwise(left))
    return judged_.withColumn("kept", F.coalesce(~F.col("base_failed") & ((F.col("n_words") - F.col("n_words_left")) * 100 <= F.col("n_words") * MAX_LOST), F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    rows = judged(pick(docs, "doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")
