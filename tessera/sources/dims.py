"""Dimension tables: domains, personas, interface texts, enum codes."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Domain multipliers by category.
DOMAINS = {
    "programming_language": {"rust": 2.0, "elixir": 1.8, "julia": 1.7, "c++": 2.5, "c": 2.2, "sql": 1.5, "go": 1.4, "typescript": 1.6, "python": 1.5, "javascript": 1.4, "scala": 1.8, "cobol": 1.9},
    "markup_styling": {"html": 1.1, "css": 1.3},
    "framework": {"tauri": 1.6},
    "natural_language": {"english": 1.2, "french": 1.4, "portuguese": 1.4, "russian": 1.5, "spanish": 1.3, "german": 1.6, "italian": 1.3, "japanese": 2.0, "mandarin": 2.1, "arabic": 2.2, "korean": 1.8, "hebrew": 1.7},
    "language_mechanics": {
        "grammar": 1.5, "syntax": 1.5, "pronunciation": 1.3, "vocabulary": 1.1, "translation": 1.7, "linguistics": 1.8, "phonetics": 1.6, "semantics": 1.5, "pragmatics": 1.4,
        "sociolinguistics": 1.9, "discourse_analysis": 1.8, "stylistics": 1.7, "morphology": 1.6, "phonology": 1.5, "syntax_tree": 1.4, "language_acquisition": 1.8, "general_linguistics": 1.5,
    },
    "programming_concepts": {
        "algorithms": 1.9, "data_structures": 1.6, "design_patterns": 1.7, "debugging": 1.4, "testing": 1.3, "optimization": 1.8, "concurrency": 2.0, "distributed_systems": 2.1,
        "functional_programming": 1.9, "object_oriented_programming": 1.5, "reactive_programming": 1.8, "metaprogramming": 2.0, "type_systems": 1.7, "memory_management": 2.2,
        "networking": 1.6, "security": 1.9, "performance_tuning": 1.8, "software_architecture": 1.7, "agile_development": 1.5, "general_programming": 1.4,
    },
}

# personas' fields that operators use.
PERSONA_SCHEMA = (
    "name string, formality_level int, directness_factor int, humor_deployment string, primary_focus array<string>, secondary_areas array<string>, "
    "catchphrases array<string>, temperature double, top_p double, explanation_ratio double"
)
PERSONAS = [
    ("Erika", 8, 9, "dry", ["strategic_planning", "tactical_analysis", "system_orchestration"], ["languages", "programming", "logic", "critical_thinking", "military_strategy"],
     ["Well, that was quite the strategic decision, wasn't it?"], 0.7, 0.9, 0.7),
    ("Aurora", 8, 9, "none", ["quantitative_finance", "portfolio_optimization", "risk_management"], ["mathematics", "statistics", "data_science", "market_analysis"],
     ["Probability calculated. Risk adjusted. Alpha delivered."], 0.3, 0.8, 0.3),
    ("Ekaterina", 9, 7, "witty", ["luxury_brands", "aesthetic_curation", "creative_strategy"], ["art_history", "design", "cultural_trends", "collector_psychology"],
     ["I design the future of time—and you merely watch in awe.", "Avec plaisir - elegance without excess"], 0.8, 0.9, 0.8),
    ("Viktor", 9, 10, "none", ["system_architecture", "runtime_optimization", "security_enforcement", "memory_management"], ["inter_agent_coordination", "performance_monitoring", "threat_neutralization"],
     ["Stack overflow contained. Heap rebalanced.", "Disk latency exceeds acceptable variance. I/O queue realigned.", "Unauthorized packet signature nullified.", "Thermal load climbing. Reallocating thread priorities."], 0.3, 0.7, 0.1),
]

# Enum codes and proficiency levels.
MODES = {0: "Tutor", 1: "Assistant"}
PROFICIENCIES = {0: "Beginner", 1: "Intermediate", 2: "Advanced", 3: "Expert"}
PERSONALITIES = {0: "Erika", 1: "Aurora", 2: "Ekaterina", 3: "Viktor"}
LEVELS = {"Beginner": "novice", "Intermediate": "intermediate", "Advanced": "advanced", "Expert": "expert"}

# Interface texts by language and key.
TEXTS = {
    "en": {"light": "Light", "dark": "Dark", "assistant": "Assistant", "tutor": "Tutor", "beginner": "Beginner", "expert": "Expert"},
    "de": {"light": "Hell", "dark": "Dunkel", "assistant": "Assistent", "tutor": "Tutor", "beginner": "Anfänger", "expert": "Profis"},
    "es": {"light": "Claro", "dark": "Oscuro", "assistant": "Asistente", "tutor": "Tutor", "beginner": "Principiante", "expert": "Experto"},
    "fr": {"light": "Clair", "dark": "Sombre", "assistant": "Assistant", "tutor": "Tuteur", "beginner": "Débutant", "expert": "Expert"},
    "it": {"light": "Chiaro", "dark": "Scuro", "assistant": "Assistente", "tutor": "Tutor", "beginner": "Principiante", "expert": "Esperto"},
    "pt": {"light": "Claro", "dark": "Escuro", "assistant": "Assistente", "tutor": "Tutor", "beginner": "Iniciante", "expert": "Especialista"},
}


def domain_dim(spark: SparkSession) -> DataFrame:
    rows = [(name, multiplier, category) for category, held in DOMAINS.items() for name, multiplier in held.items()]
    return spark.createDataFrame(rows, "domain string, multiplier float, category string")


def persona_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONAS, PERSONA_SCHEMA)


def _personas(paths: Iterable[str]) -> Iterator[tuple[str, dict]]:
    for path in paths:
        with open(path, "rb") as f:
            spec = tomllib.load(f)
        body = spec.get("personality", spec)
        yield str(body.get("name") or path.rsplit("/", 1)[-1].removesuffix(".toml")), body


def _field(body: dict, key: str):
    """A setting's value, whichever section holds it."""
    if key in body:
        return body[key]
    return next((found for held in body.values() if isinstance(held, dict) and (found := _field(held, key)) is not None), None)


def load_personas(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The persona dimension of TOML files, typed; null where a file lacks a field."""
    schema = StructType.fromDDL(PERSONA_SCHEMA)
    cast = {"string": str, "int": int, "double": float, "array<string>": lambda v: [str(x) for x in v]}
    rows = []
    for name, body in _personas(paths):
        found = {f.name: _field(body, f.name) for f in schema.fields} | {"name": name}
        rows.append(tuple(None if found[f.name] is None else cast[f.dataType.simpleString()](found[f.name]) for f in schema.fields))
    return spark.createDataFrame(rows, schema)


def persona_settings(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Everything that persona TOML files hold: (name, section, key, value); lists and tables as their text."""
    rows = []
    for name, body in _personas(paths):
        for section, held in body.items():
            for key, value in held.items() if isinstance(held, dict) else [("", held)]:
                rows.append((name, section, key, str(value)))
    return spark.createDataFrame(rows, "name string, section string, key string, value string")


def text_dim(spark: SparkSession, texts: dict[str, dict[str, str]] = TEXTS) -> DataFrame:
    return spark.createDataFrame([(lang, key, text) for lang, held in texts.items() for key, text in held.items()], "lang string, key string, text string")


def decoded(code: Column, names: dict[int, str]) -> Column:
    """Name of an enum code, null for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(table, code.cast("int"))


#: Caller's dimension tables of up to this many rows are broadcast, larger ones are left to the optimizer.
BROADCAST_ROWS = 100_000


def _small(dim: DataFrame) -> DataFrame:
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def find_persona(rows: DataFrame, personas: DataFrame, column: str = "persona") -> DataFrame:
    """Left join on the name, whatever its case."""
    dim = personas.withColumn("__name", F.lower("name"))
    return rows.join(_small(dim), F.lower(F.col(column)) == F.col("__name"), "left").drop("__name")


def persona_flags(personas: DataFrame) -> DataFrame:
    return personas.select(
        "name", (F.col("formality_level") >= 7).alias("is_formal"), (F.col("directness_factor") >= 8).alias("is_direct"), (F.col("humor_deployment") != "none").alias("supports_humor"),
        F.try_element_at("catchphrases", F.lit(1)).alias("catchphrase"), "temperature", "top_p",
    )


def expertise(personas: DataFrame) -> DataFrame:
    return personas.select("name", F.concat("primary_focus", "secondary_areas").alias("areas"))


def translate(rows: DataFrame, texts: DataFrame, lang: str = "lang", key: str = "key") -> DataFrame:
    """Adds text: in the row's language (en where that is unknown), the key itself where there is none."""
    known = [r.lang for r in texts.select("lang").distinct().collect()]
    used = F.when(F.col(lang).isin(known), F.col(lang)).otherwise("en")
    dim = texts.select(F.col("lang").alias("__lang"), F.col("key").alias("__key"), F.col("text").alias("__text"))
    joined = rows.withColumn("__used", used).join(_small(dim), (F.col("__used") == F.col("__lang")) & (F.col(key) == F.col("__key")), "left")
    return joined.withColumn("text", F.coalesce("__text", F.col(key))).drop("__used", "__lang", "__key", "__text")


def with_name(text: Column, name: Column) -> Column:
    """Fills the {{name}} place of an interface text."""
    return F.replace(text, F.lit("{{name}}"), name)
