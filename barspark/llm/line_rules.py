"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much is rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, row_of, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Marks that prose hardly uses; full stops and commas are not among them.
MARKS = r"[#*$%&|<>!?~^=_{}\\]"
BARS = r"[|>]"
#: Fixed phrases by language, English, German, French, Spanish: whole lines that lead elsewhere, and what sites add to a text.
#: Letters beyond ASCII stand as classes, since the flag (?i) folds A-Z alone in Java.
LEADS = (
    "home|menu|log ?in|sign (in|up)|register|next|previous|back to top|read more|click here|share|search|contact( us)?|about( us)?",
    "startseite|men[üÜ]|anmelden|registrieren|weiter|zur[üÜ]ck|nach oben|mehr lesen|weiterlesen|teilen|suche|kontakt|impressum|[üÜ]ber uns",
    "accueil|connexion|se connecter|s['’]inscrire|suivant|pr[éÉ]c[éÉ]dent|haut de page|lire la suite|cliquez ici|partager|recherche|contactez[ -]nous|[àÀ] propos",
    "inicio|men[úÚ]|iniciar sesi[óÓ]n|registrarse|siguiente|anterior|volver arriba|leer m[áÁ]s|haga clic aqu[íÍ]|compartir|buscar|contacto|sobre nosotros",
)
ADDED = (
    "all rights reserved|copyright|licensed under|released under the|privacy policy|cookie policy|terms of (use|service)|subscribe to our",
    "alle rechte vorbehalten|datenschutzerkl[äÄ]rung|cookie-richtlinie|allgemeine nutzungsbedingungen|abonnieren sie unser",
    "tous droits r[éÉ]serv[éÉ]s|politique de (confidentialit[éÉ]|cookies)|conditions (g[éÉ]n[éÉ]rales )?d['’]utilisation|abonnez-vous [àÀ]",
    "todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|t[éÉ]rminos (de (uso|servicio)|y condiciones)|suscr[íÍ]base a",
)
NAVIGATION = rf"(?i)^[ \t]*({'|'.join(LEADS)})[ .:!]*$"
BOILERPLATE = rf"(?i)({'|'.join(ADDED)})"


@dataclass(frozen=True)
class LineRules:
    """Shares are in percent. ``marks``: of a line's word characters; ``repeats``: of the words; ``lost``: of the word characters of the text.
    ``phrase_words``, ``bar_words``: a line fails for a boilerplate phrase in every so many words, or for ``bars`` bars if there
    is one in every so many words, so that a mention in a long line is no fault; with 0 one is enough, whatever the length."""

    marks: int = 10
    bars: int = 3
    min_words: int = 10
    repeats: int = 20
    window: int = 5
    lost: int = 50
    phrase_words: int = 25
    bar_words: int = 10


def repeated_words(words: Column, window: int) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text."""

    def counted(w: Column, grams: Column) -> Column:
        return let(
            F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), x["h"].alias("h"), F.get(s, j - 1)["h"].alias("before"), F.get(s, j + 1)["h"].alias("after"))),
                            lambda x: F.coalesce(x["h"] == x["before"], F.lit(False)) | F.coalesce(x["h"] == x["after"], F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(window)), F.lit(window))),
                    F.lit(0).cast("long"),
                    lambda total, n: total + n,
                ),
            ),
        )

    def gram(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(window)])

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: gram(w, i))
        found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(counted(w, g)))
        return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(found)

    return let(words, of)


def line_passes(line: Column, rules: LineRules) -> Column:
    """The punctuation, navigation and boilerplate rules; a line without a word passes."""
    chars = F.length(F.regexp_replace(line, SPACES, ""))
    marked = F.regexp_count(line, F.lit(MARKS)) * 100 > chars * rules.marks
    barred, boilerplate, words = F.regexp_count(line, F.lit(BARS)) >= rules.bars, line.rlike(BOILERPLATE), F.regexp_count(line, F.lit(WORD))
    if rules.bar_words:
        barred = barred & (F.regexp_count(line, F.lit(BARS)) * rules.bar_words >= words)
    if rules.phrase_words:
        boilerplate = boilerplate & (F.regexp_count(line, F.lit(BOILERPLATE)) * rules.phrase_words >= words)
    return ~(marked | barred | line.rlike(NAVIGATION) | boilerplate)


def clean(
    docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """A row for each row of ``docs``: id, the counts, ``base_failed``, ``cleaned`` (lines that pass), ``kept``; with
    ``carry`` also ``row``, the whole row as a struct.

    A null text has no word and is rejected, as an empty one is. Lines without a word stay as they are. Rows that
    repeat are judged alike; other columns are not read; an empty table gives none.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    row = [row_of(docs).alias("row")] if carry else []
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), *row).select(
        "*", words_of(F.col("t")).alias("w"), F.split(text, "\n").alias("lines")
    )
    counted = base.select(
        "id",
        *(["row"] if carry else []),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(
            F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        ).alias("n_dup_lines"),
        repeated_words(F.col("w"), rules.window).alias("n_repeat_words"),
        F.array_join(F.filter("lines", lambda x: line_passes(x, rules)), "\n").alias("cleaned"),
    )
    left = F.length(F.regexp_replace("cleaned", SPACES, ""))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.repeats)
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & ((F.col("word_chars") - left) * 100 <= F.col("word_chars") * rules.lost)
    )
