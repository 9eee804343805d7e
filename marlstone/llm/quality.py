"""Quality rules, line first: clean each document line by line, then judge what is left.

Only DataFrame functions: whole documents stay in one row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"

#: A line that carries one of these, whatever its case, is boilerplate: English, German, French, Spanish.
BOILERPLATE = (
    *("all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "lorem ipsum", "enable javascript", "subscribe to our newsletter"),
    *("alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "bitte javascript aktivieren", "newsletter abonnieren"),
    *("tous droits réservés", "politique de cookies", "politique de confidentialité", "conditions d'utilisation", "conditions générales", "activer javascript", "abonnez-vous à notre"),
    *("todos los derechos reservados", "política de cookies", "política de privacidad", "términos de uso", "condiciones de uso", "activar javascript", "suscríbete a nuestro"),
)
#: A line of at most NAVIGATION_WORDS words that begins with one of these is navigation.
NAVIGATION = (
    *("home", "menu", "search", "login", "log in", "sign in", "sign up", "share", "next", "previous", "read more", "click here", "back to top", "skip to content"),
    *("startseite", "menü", "suche", "anmelden", "registrieren", "teilen", "weiter", "zurück", "weiterlesen", "hier klicken", "nach oben", "zum inhalt"),
    *("accueil", "recherche", "connexion", "se connecter", "s'inscrire", "partager", "suivant", "précédent", "lire la suite", "cliquez ici", "haut de page", "aller au contenu"),
    *("inicio", "menú", "buscar", "iniciar sesión", "registrarse", "compartir", "siguiente", "anterior", "leer más", "haz clic aquí", "volver arriba", "saltar al contenido"),
)
NAVIGATION_WORDS = 5


def any_case(words: tuple[str, ...]) -> str:
    """The words as alternatives; letters beyond ASCII in both cases, for engines that fold ASCII only."""
    return "|".join("".join(c if c.isascii() else f"[{c}{c.upper()}]" for c in w) for w in words)


NAVIGATION_RE = f"(?i)^({any_case(NAVIGATION)})([^\\pL\\pN]|$)"
SEPARATORS_RE = "[|»›•·].*[|»›•·]"
TERMINAL_RE = "[.!?:;…。！？][\"'”’)\\]]*$"
LETTER_RE = r"[\pL\pN]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def space_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WORD, ""))


def count_repeats(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda k, j: F.get(s, j)["h"] == F.get(s, k)["h"]
            twice = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
            )
            starts = F.transform(twice, lambda k: F.get(s, k)["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(keyed, positions))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered))


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for a line that has a word."""

    def judged(s: Column) -> Column:
        n_words = F.regexp_count(s, F.lit(WORD))
        symbols = F.length(F.regexp_replace(s, NOT_SYMBOLS, ""))
        return (
            ~s.rlike(LETTER_RE)
            | (symbols * 10 > F.length(s))
            | ((n_words < 3) & ~s.rlike(TERMINAL_RE))
            | s.rlike(SEPARATORS_RE)
            | ((n_words <= NAVIGATION_WORDS) & s.rlike(NAVIGATION_RE) & ~s.rlike(TERMINAL_RE))
            | let(F.lower(s), lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in BOILERPLATE]))  # faster than a pattern of many words
        )

    return let(F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", ""), judged)


def measure(docs: DataFrame, text: str = "text", max_lost_percent: int = 50, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Add the measures, the verdict ``kept`` and ``clean_text`` to every row of ``docs``.

    A null text counts as empty: no words, so it fails the base rules. Rows are judged one
    by one, so ties and repeated rows need no rule; an empty table gives an empty result.
    Columns of ``docs`` with the names of added columns are replaced; others stay.
    A document loses too much when failing lines hold over ``max_lost_percent`` of its
    word characters. A text of any length is judged whole, in one row and in time that
    grows with its words (times their logarithm where windows repeat).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    has_word = lambda x: x.rlike(WORD)
    fails = lambda x: has_word(x) & line_fails(x)
    chars = lambda c: (F.length(c) - space_count(c)).cast("long")
    word_stats = let(
        words_of(F.col(text)),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), count_repeats(ws).cast("long").alias("n_repeat_words")),
    )
    line_stats = let(
        lines,
        lambda ls: F.struct(
            let(F.filter(ls, has_word), lambda full: F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            let(F.array_join(F.filter(ls, lambda x: ~fails(x)), "\n"), lambda c: F.struct(c.alias("text"), chars(c).alias("chars"))).alias("clean"),
        ),
    )
    symbols = F.length(F.regexp_replace(body, NOT_SYMBOLS, "")).cast("long")
    # explode of one row, so that Spark works the measures out once and not again for every use
    stats = F.explode(F.array(F.struct(word_stats.alias("words"), line_stats.alias("lines"), chars(body).alias("word_chars"), symbols.alias("n_symbols"))))
    m = lambda field: F.col(f"__m.{field}")
    out = docs.withColumn("__m", stats).withColumns(
        {
            "n_words": m("words.n_words"),
            "word_chars": m("word_chars"),
            "n_symbols": m("n_symbols"),
            "n_dup_lines": m("lines.n_dup_lines"),
            "n_repeat_words": m("words.n_repeat_words"),
            "clean_text": m("lines.clean.text"),
            "clean_chars": m("lines.clean.chars"),
        }
    )
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = (F.col("word_chars") - F.col("clean_chars")) * 100 > max_lost_percent * F.col("word_chars")
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~lost).drop("__m")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their clean text, in the columns of ``docs``; ``n_chars`` follows."""
    rest = [c for c in docs.columns if c != "text"]
    out = measure(docs.select("text", F.struct(*rest).alias("__rest"))).where("kept")
    new = {"text": F.col("clean_text").alias("text"), "n_chars": F.length("clean_text").cast("long").alias("n_chars")}
    return out.select(*(new.get(c, F.col(f"__rest.{c}")) for c in docs.columns))
