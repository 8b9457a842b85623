"""Technologies and the fields that they belong to: a taxonomy as a table, its layers, names found in texts, hints of imports, order by score."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_of

# Fields by layer, names of languages, the technologies of each field.
RUNTIME = ("framework-frontend", "framework-backend", "framework-fullstack", "webserver", "database", "cache", "queue", "search", "container", "mobile", "desktop", "auth", "api", "payment", "ai", "orm")
DEVOPS = ("iac", "ci", "observability")
LANGUAGE_NAMES = ("JavaScript", "TypeScript", "Python", "Go", "Rust", "Java", "C", "C++", "Kotlin", "Scala", "Swift", "Dart", "C#", ".NET", "PHP", "Ruby")
FIELDS = {
    "framework-frontend": ("React", "Vue", "Svelte", "Angular", "Solid", "Streamlit", "Gradio"),
    "framework-fullstack": ("Next.js", "Nuxt", "Remix", "Astro"),
    "framework-backend": ("Express", "Fastify", "NestJS", "Koa", "Hono", "FastAPI", "Django", "Flask", "Gin", "Echo", "Fiber", "Actix Web", "Axum", "Rocket", "Spring", "Spring Boot", "Quarkus", "Micronaut"),
    "desktop": ("Electron", "Tauri", "Tauri Apps"),
    "mobile": ("Flutter", "React Native", "Expo"),
    "orm": ("Prisma", "TypeORM", "Sequelize", "Drizzle", "GORM", "SQLAlchemy", "SQLx", "Diesel", "SeaORM", "Hibernate", "MyBatis"),
    "database": ("PostgreSQL", "MySQL", "MongoDB", "SQLite", "MariaDB", "ClickHouse", "Cassandra", "InfluxDB"),
    "cache": ("Redis",),
    "search": ("Elasticsearch", "OpenSearch", "Meilisearch", "Algolia"),
    "queue": ("RabbitMQ", "Kafka", "NATS", "Bull", "Celery"),
    "webserver": ("Nginx", "Caddy", "Traefik", "Apache", "HAProxy"),
    "container": ("Docker", "Docker Compose", "Podman"),
    "iac": ("Kubernetes", "Terraform", "Pulumi", "Ansible", "CloudFormation", "Bicep", "Helm", "Kustomize"),
    "ci": ("GitHub Actions", "GitLab CI", "CircleCI", "Jenkins", "Travis CI", "Azure Pipelines"),
    "observability": ("Prometheus", "Grafana", "Sentry", "OpenTelemetry", "Datadog", "Loki", "Jaeger"),
    "auth": ("Passport.js", "Auth.js (NextAuth)", "Clerk", "Auth0", "Keycloak", "JWT", "OAuth2/OIDC", "OAuth2"),
    "api": ("gRPC", "GraphQL", "tRPC", "OpenAPI/Swagger", "REST", "MCP"),
    "payment": ("Stripe", "PayPal"),
    "ai": ("OpenAI SDK", "Anthropic SDK", "Google Generative AI", "Cohere", "LangChain", "LangGraph", "LlamaIndex", "Hugging Face", "PyTorch", "TensorFlow"),
}
#: Older names of fields.
OLD_FIELDS = {"frontend": "framework-frontend", "backend": "framework-backend", "fullstack": "framework-fullstack"}
# Tools that count as technologies of the field ai.
PROMOTED = {
    "pandas": "pandas", "numpy": "NumPy", "polars": "Polars", "dask": "Dask", "scikit-learn": "scikit-learn", "pytorch": "PyTorch", "tensorflow": "TensorFlow", "jax": "JAX", "keras": "Keras",
    "transformers": "Hugging Face", "datasets": "Hugging Face", "huggingface-hub": "Hugging Face",
}
# Scores of the technologies above; what has none counts as DEFAULT_SCORE. Callers may give others.
SCORES = {
    "React": 100, "Vue": 95, "Angular": 80, "Svelte": 70, "Solid": 45, "Streamlit": 70, "Gradio": 65, "Next.js": 95, "Nuxt": 70, "Remix": 55, "Astro": 50,
    "Express": 100, "Fastify": 60, "NestJS": 85, "Koa": 50, "Hono": 55, "FastAPI": 95, "Django": 90, "Flask": 75, "Gin": 75, "Echo": 45, "Fiber": 50, "Actix Web": 55, "Axum": 65, "Rocket": 45,
    "Spring Boot": 100, "Quarkus": 55, "Micronaut": 45, "Electron": 85, "Tauri": 60, "Flutter": 90, "React Native": 80, "Expo": 70,
    "Prisma": 95, "TypeORM": 60, "Sequelize": 55, "Drizzle": 75, "GORM": 65, "SQLAlchemy": 80, "Diesel": 45, "SeaORM": 40, "Hibernate": 65, "MyBatis": 50,
    "PostgreSQL": 100, "MySQL": 85, "MongoDB": 80, "SQLite": 65, "MariaDB": 55, "ClickHouse": 55, "Cassandra": 35, "InfluxDB": 40, "Redis": 100,
    "Elasticsearch": 80, "OpenSearch": 50, "Meilisearch": 35, "Algolia": 50, "RabbitMQ": 90, "Kafka": 95, "NATS": 55, "Bull": 50, "Celery": 65,
    "Nginx": 100, "Caddy": 50, "Traefik": 55, "Apache": 80, "HAProxy": 50, "Docker": 90, "Docker Compose": 100, "Podman": 45, "Kubernetes": 100,
    "Terraform": 90, "Pulumi": 50, "Ansible": 70, "CloudFormation": 55, "Bicep": 45, "Helm": 65, "Kustomize": 45,
    "GitHub Actions": 100, "GitLab CI": 70, "CircleCI": 50, "Jenkins": 55, "Travis CI": 30, "Azure Pipelines": 45,
    "Prometheus": 90, "Grafana": 85, "Sentry": 80, "OpenTelemetry": 75, "Datadog": 70, "Loki": 60, "Jaeger": 45,
    "Passport.js": 50, "Auth.js (NextAuth)": 70, "Clerk": 55, "Auth0": 50, "Keycloak": 65, "JWT": 60, "OAuth2/OIDC": 55, "OAuth2": 50,
    "gRPC": 75, "GraphQL": 85, "tRPC": 55, "OpenAPI/Swagger": 65, "REST": 50, "MCP": 70, "Stripe": 90, "PayPal": 50,
    "OpenAI SDK": 100, "Anthropic SDK": 95, "Google Generative AI": 75, "Cohere": 55, "LangChain": 90, "LangGraph": 88, "LlamaIndex": 75, "Hugging Face": 85, "PyTorch": 90, "TensorFlow": 80,
}
DEFAULT_SCORE = 50


def table(spark: SparkSession) -> DataFrame:
    """``name, field, layer`` of all technologies; under 150 rows."""
    return spark.createDataFrame([(n, f, "devops" if f in DEVOPS else "runtime") for f, names in FIELDS.items() for n in names], "name string, field string, layer string")


def placed(rows: DataFrame, name: str = "name") -> DataFrame:
    """``rows`` with the ``field`` and ``layer`` of their technology: names of languages go, unknown names are in the field ``_extra`` and the layer ``extra``."""
    known = F.broadcast(table(rows.sparkSession).withColumnRenamed("name", "_name"))
    met = rows.where(F.col(name).isNotNull() & (F.col(name) != "") & ~F.col(name).isin(*LANGUAGE_NAMES)).join(known, F.col(name) == F.col("_name"), "left").drop("_name")
    return met.withColumn("field", F.coalesce("field", F.lit("_extra"))).withColumn("layer", F.coalesce("layer", F.lit("extra")))


def mentioned(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name, times``: technologies that a text names as whole words; where several names fit, the longest counts. One pass of one pattern."""
    names = sorted((n for v in FIELDS.values() for n in v), key=lambda n: (-len(n), n))
    # a trie of the names would walk the same way: the longest one that fits at a place is taken, and the walk goes on behind it
    pattern = r"(?<![\w.])(" + "|".join(re.escape(n).replace(r"\ ", " ").replace("/", "/") for n in names) + r")(?![\w])"
    found = texts.select(F.col(key), F.explode(F.regexp_extract_all(text_of(text), F.lit(pattern), F.lit(1))).alias("name"))
    return found.groupBy(key, "name").agg(F.count("*").alias("times"))


def layers(stack: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``project, layer, field, names``: technologies (``project, field, value``) by layer, in the order of their scores.

    A project without any takes those of ``fallback`` (fields under their older names), less languages.
    """
    field = F.col("field")
    for old, new in OLD_FIELDS.items():
        field = F.when(F.col("field") == old, new).otherwise(field)
    known = stack.where(F.col("field").isin(*RUNTIME, *DEVOPS, "_extra") & F.col("value").isNotNull()).where(~((F.col("field") == "_extra") & F.col("value").isin(*LANGUAGE_NAMES)))
    rows = known.select("project", "field", "value")
    if fallback is not None:
        other = fallback.join(known.select("project").distinct(), "project", "left_anti").withColumn("field", field)
        rows = rows.unionByName(other.where(F.col("field").isin(*RUNTIME, *DEVOPS, "_extra") & ~F.col("value").isin(*LANGUAGE_NAMES)).select("project", "field", "value"))
    layer = F.when(F.col("field").isin(*DEVOPS), "devops").when(F.col("field") == "_extra", "extra").otherwise("runtime")
    by = F.struct((-score(F.col("value"))).alias("s"), F.col("value").alias("v"))
    return rows.distinct().groupBy("project", layer.alias("layer"), "field").agg(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["v"]).alias("names"))


def score(value: Column, scores: dict[str, int] | None = None) -> Column:
    """A technology's score, DEFAULT_SCORE if it has none."""
    known = scores or SCORES
    told = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(told[value], F.lit(DEFAULT_SCORE))


def by_score(stack: DataFrame, scores: dict[str, int] | None = None) -> DataFrame:
    """``project, field, value, rank``: a project's technologies of a field, the most popular first; of equal ones by name."""
    w = Window.partitionBy("project", "field").orderBy(F.desc(score(F.col("value"), scores)), "value")
    return stack.select("project", "field", "value").distinct().withColumn("rank", F.row_number().over(w))


def promoted(stack: DataFrame, tooling: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stack`` with the tools (``project, value``) that count as technologies of the field ai, and the other tools."""
    name = F.create_map(*(F.lit(x) for pair in PROMOTED.items() for x in pair))[F.col("value")]
    told = tooling.withColumn("_n", name)
    up = told.where("_n is not null").select("project", F.lit("ai").alias("field"), F.col("_n").alias("value"))
    return stack.select("project", "field", "value").unionByName(up).distinct(), told.where("_n is null").drop("_n")


# Packages that sources import, with the field and the name that each hints at.
HINTS = {
    "framework-backend": {
        "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "starlette": "Starlette", "aiohttp": "aiohttp", "tornado": "Tornado", "sanic": "Sanic", "falcon": "Falcon", "hug": "Hug", "litestar": "Litestar",
        "pydantic": "Pydantic", "boto3": "Boto3", "express": "Express", "fastify": "Fastify", "koa": "Koa", "hapi": "Hapi", "hono": "Hono", "@nestjs/core": "NestJS",
    },
    "queue": {"celery": "Celery", "rq": "RQ", "dramatiq": "Dramatiq", "kafka": "Kafka", "aiokafka": "Kafka", "confluent_kafka": "Kafka", "nats": "NATS"},
    "orm": {
        "sqlalchemy": "SQLAlchemy", "peewee": "Peewee", "tortoise": "Tortoise ORM", "pony": "Pony ORM", "dataset": "dataset", "piccolo": "Piccolo", "ormar": "Ormar",
        "prisma": "Prisma", "typeorm": "TypeORM", "sequelize": "Sequelize", "drizzle-orm": "Drizzle", "mongoose": "Mongoose",
    },
    "cache": {"redis": "Redis", "aioredis": "Redis", "pymemcache": "Memcached"},
    "database": {"pymongo": "MongoDB", "motor": "MongoDB", "asyncpg": "PostgreSQL", "psycopg2": "PostgreSQL", "psycopg": "PostgreSQL", "pymysql": "MySQL", "aiomysql": "MySQL", "mysqlclient": "MySQL"},
    "search": {"elasticsearch": "Elasticsearch", "opensearchpy": "OpenSearch"},
    "ai": {
        "pandas": "pandas", "numpy": "NumPy", "polars": "Polars", "dask": "Dask", "sklearn": "scikit-learn", "scikit-learn": "scikit-learn", "scikit_learn": "scikit-learn", "torch": "PyTorch", "tensorflow": "TensorFlow",
        "keras": "Keras", "jax": "JAX", "transformers": "Hugging Face", "datasets": "Hugging Face", "huggingface_hub": "Hugging Face", "langchain": "LangChain", "langchain_core": "LangChain", "langgraph": "LangGraph",
        "llama_index": "LlamaIndex", "openai": "OpenAI SDK", "anthropic": "Anthropic SDK", "cohere": "Cohere", "google.generativeai": "Google Generative AI", "tiktoken": "tiktoken",
        "matplotlib": "Matplotlib", "seaborn": "Seaborn", "plotly": "Plotly", "bokeh": "Bokeh", "altair": "Altair",
    },
    "framework-frontend": {"streamlit": "Streamlit", "gradio": "Gradio", "dash": "Dash", "panel": "Panel", "react": "React", "vue": "Vue", "svelte": "Svelte"},
    "framework-fullstack": {"next": "Next.js", "nuxt": "Nuxt"},
    "desktop": {"electron": "Electron", "@tauri-apps/api": "Tauri"},
    "auth": {"passport": "Passport.js", "next-auth": "Auth.js (NextAuth)"},
    "payment": {"stripe": "Stripe"},
}
#: Forms of imports; {} is a package.
_FORMS = (
    r"(?m)(?:^|\s)import\s+['\"]?({})['\"]?(?:\s*as\s+\w+|(?=\s)|;|$)", r"(?m)(?:^|\s)from\s+['\"]?({})(?:\.\w+)?['\"]?\s+import", r"(?m)(?:^|\s|;)from\s+['\"]({})(?:[/.][^'\"]+)?['\"]",
    r"(?m)(?:^|\s|;|\()(?:import\s+(?:[^'\"]*\s+from\s+)?|require\(\s*)['\"]({})(?:[/.][^'\"]+)?['\"]",
)


def hint_hits(sources: DataFrame, lines: int | None = 60) -> DataFrame:
    """``project, hint, files``: files of a project (``project, text``) whose first ``lines`` lines import a package that hints at a technology.

    All packages are looked for in one pass of a pattern a form of import. The limit of lines is that of the behaviour followed; None: whole texts.
    """
    hints = "|".join(re.escape(h) for h in sorted((h for v in HINTS.values() for h in v), key=lambda h: (-len(h), h)))
    body = text_of("text") if lines is None else F.array_join(F.slice(F.split(text_of("text"), "\n"), 1, lines), "\n")
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.col("_b"), F.lit(f.format(hints)), F.lit(1)) for f in _FORMS))))
    return sources.select("project", body.alias("_b")).select("project", F.explode(found).alias("hint")).groupBy("project", "hint").agg(F.count("*").alias("files"))


def import_fallback(stack: DataFrame, sources: DataFrame, lines: int | None = 60) -> DataFrame:
    """``project, field, value, files``: technologies that the imports of a project hint at, for projects of which ``stack`` tells nothing."""
    named = sources.sparkSession.createDataFrame([(h, f, v) for f, hints in HINTS.items() for h, v in hints.items()], "hint string, field string, value string")
    bare = sources.join(stack.select("project").distinct(), "project", "left_anti")
    return hint_hits(bare, lines).join(F.broadcast(named), "hint").groupBy("project", "field", "value").agg(F.sum("files").alias("files"))
