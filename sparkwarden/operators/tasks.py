"""File discovery, audit tasks and prompts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.paths import SCAN_EXTENSIONS, PathFilter, has_extension, relative_path

# Prompt texts around the configured templates.
ROLE_TEXT = """Sei un Auditor di Codice Senior.
Analizza il codice e identifica problemi, vulnerabilità e opportunità di miglioramento.

IMPORTANTE:
- RISPONDI SOLO IN FORMATO JSON VALIDO
- Non includere testo prima o dopo il JSON
- Il JSON deve essere parseabile direttamente
"""
PRACTICES_BEFORE = """
BEST PRACTICES DA VERIFICARE:
"""
PRACTICES_AFTER = """

Verifica che il codice rispetti queste best practices. Per ogni violazione:
- severity: critical/high/medium/low
- category: categoria della best practice violata
- description: descrizione della violazione
- line_number: numero di riga
- code_snippet: snippet del codice
- recommendation: come correggere
- reference: quale best practice è stata violata
"""
SYSTEM_TEXT = (
    "Sei un auditor di codice senior. "
    "Rispondi SOLO con JSON valido, senza testo prima o dopo. "
    "Non aggiungere markdown, backtick o spiegazioni."
)
SYSTEM_PRACTICES = "\n\nBest practices di riferimento:\n"
USER_FILE = ("\n\nContenuto del file `", "`:\n```\n", "\n```")
USER_DEFAULT = (
    "Analizza il file `",
    "` e restituisci un JSON con:\n"
    "- findings: lista di problemi trovati (severity, category, description, recommendation)\n"
    "- overall_score: punteggio 0-100\n"
    "- summary: breve riepilogo\n\n"
    "Contenuto:\n```\n",
    "\n```",
)
PRACTICES_LIMIT = 8000
UNKNOWN_TYPE = "analysis_type non trovato nella piattaforma"

TYPE_SCHEMA = "platform STRING, analysis_type STRING, type_name STRING, prompt_template STRING"


def discover_files(
    corpus: DataFrame,
    extensions: Iterable[str] = SCAN_EXTENSIONS,
    path_filter: PathFilter = PathFilter(),
    wanted: DataFrame | Sequence[str] | None = None,
) -> DataFrame:
    """The eligible rows of a corpus; predicates only, so they run on the scan.

    ``wanted`` is an explicit path list and replaces discovery altogether, unless it is empty.
    """
    chosen = eligible(corpus, extensions, path_filter)
    if wanted is None:
        return chosen
    if not isinstance(wanted, DataFrame):
        if not wanted:
            return chosen
        wanted = corpus.sparkSession.createDataFrame([(p,) for p in wanted], "file_path STRING")
    elif wanted.isEmpty():
        return chosen
    return corpus.join(wanted.select("file_path"), "file_path", "left_semi")


def eligible(corpus: DataFrame, extensions: Iterable[str], path_filter: PathFilter) -> DataFrame:
    path, root = F.col("file_path"), F.col("root")
    return corpus.filter(has_extension(path, extensions)).filter(path_filter.keep(path, root))


def distinct_paths(corpus: DataFrame) -> DataFrame:
    """Each path once. Only the path column is shuffled, never the content."""
    return corpus.select("root", "file_path").distinct()


def audit_tasks(files: DataFrame, requested: Sequence[str], types: DataFrame) -> DataFrame:
    """One task per file and requested analysis type.

    The short type list is unfolded on each row (no join over pairs); the type table, as small as the
    configuration, is looked up by broadcast. A type it lacks leaves an error instead of a template, and
    so does a file that could not be read (column ``error`` of the corpus, where there is one).
    """
    names = F.array(*[F.lit(n) for n in requested]).cast("array<string>")
    unread = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return (
        files.select("*", F.explode(names).alias("analysis_type"))
        .join(F.broadcast(types.select("analysis_type", "type_name", "prompt_template")), "analysis_type", "left")
        .withColumn("error", F.coalesce(F.when(F.col("type_name").isNull(), UNKNOWN_TYPE), unread))
    )


def _fill(text: Column, path: Column) -> Column:
    named = F.replace(text, F.lit("{file_path}"), path)
    return F.replace(named, F.lit("{context}"), F.lit(""))


def full_prompt(prompt_template: Column, file_path: Column, practices: Column) -> Column:
    """Role text, best practices if there are any, and the filled template as one prompt."""
    practices = F.coalesce(practices, F.lit(""))
    section = F.when(practices == "", "").otherwise(
        F.concat(F.lit(PRACTICES_BEFORE), practices, F.lit(PRACTICES_AFTER))
    )
    return F.concat(F.lit(ROLE_TEXT), section, F.lit("\n\n"), _fill(prompt_template, file_path))


def system_prompt(practices: Column) -> Column:
    text = F.substring(F.coalesce(practices, F.lit("")), 1, PRACTICES_LIMIT)
    return F.concat(
        F.lit(SYSTEM_TEXT), F.when(text == "", "").otherwise(F.concat(F.lit(SYSTEM_PRACTICES), text))
    )


def user_prompt(prompt_template: Column, file_path: Column, root: Column, content: Column) -> Column:
    """The filled template, or a default text without one, followed by the whole file."""
    path = F.when(F.coalesce(root, F.lit("")) == "", file_path).otherwise(relative_path(file_path, root))
    with_template = F.concat(
        _fill(prompt_template, path), F.lit(USER_FILE[0]), path, F.lit(USER_FILE[1]), content, F.lit(USER_FILE[2])
    )
    without = F.concat(
        F.lit(USER_DEFAULT[0]), path, F.lit(USER_DEFAULT[1]), content, F.lit(USER_DEFAULT[2])
    )
    return F.when(F.coalesce(prompt_template, F.lit("")) == "", without).otherwise(with_template)


def with_prompts(tasks: DataFrame, practices: str = "") -> DataFrame:
    """Tasks with their system, user and full prompt; those with an error get none."""
    known = F.col("error").isNull()
    full = full_prompt(F.coalesce("prompt_template", F.lit("")), F.col("file_path"), F.lit(practices))
    return tasks.withColumn("prompt_full", F.when(known, full)).withColumn("prompt_system", F.when(known, system_prompt(F.lit(practices)))).withColumn(
        "prompt_user",
        F.when(
            known,
            user_prompt(F.col("prompt_template"), F.col("file_path"), F.col("root"), F.col("content")),
        ),
    )
