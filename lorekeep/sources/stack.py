"""Technologies of a source tree by the packages that its manifests name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of each field the technologies and the packages that show them, in order.
NPM = {
    "framework-fullstack": {"Next.js": "next", "Nuxt": "nuxt", "SvelteKit": "@sveltejs/kit", "Remix": "remix @remix-run/react", "Astro": "astro", "Qwik": "@builder.io/qwik @builder.io/qwik-city", "SolidStart": "solid-start"},
    "framework-backend": {"Express": "express", "Fastify": "fastify", "NestJS": "@nestjs/core", "Koa": "koa", "Hapi": "hapi @hapi/hapi", "AdonisJS": "@adonisjs/core", "Hono": "@hono/node-server hono", "LoopBack": "@loopback/core"},
    "framework-frontend": {
        "React": "react", "Vue": "vue", "Svelte": "svelte", "Solid": "solid solid-js", "Preact": "preact", "Angular": "angular @angular/core", "Mithril": "mithril", "Ember": "ember-source ember",
        "Stimulus": "@hotwired/stimulus", "Lit": "lit-element lit @lit/reactive-element",
    },
    "desktop": {"Electron": "electron", "Tauri": "@tauri-apps/api tauri", "Neutralino": "@neutralino/neu"},
    "mobile": {"React Native": "react-native", "Expo": "expo"},
    "orm": {
        "Prisma": "prisma @prisma/client", "TypeORM": "typeorm", "Sequelize": "sequelize sequelize-cli", "Mongoose": "mongoose", "Drizzle": "drizzle-orm drizzle", "Knex": "knex", "MikroORM": "mikro @mikro-orm/core",
        "Objection.js": "@objection.js/objection", "Bookshelf": "bookshelf", "Waterline": "waterline",
    },
    "database": {"PostgreSQL": "pg pg-promise", "MySQL": "mysql mysql2", "SQLite": "better-sqlite3 sqlite3 @sqlite.org/sqlite-wasm", "MongoDB": "mongodb mongodb-memory-server", "libSQL": "@libsql/client", "ClickHouse": "@clickhouse/client"},
    "search": {"Elasticsearch": "@elastic/elasticsearch", "Algolia": "algoliasearch", "Meilisearch": "meilisearch"},
    "cache": {"Redis": "ioredis redis", "Memcached": "memcached memjs", "Node-Cache": "node-cache", "Keyv": "@keyv/redis keyv"},
    "queue": {"Bull": "bull bullmq", "RabbitMQ": "amqplib", "Kafka": "kafkajs", "Upstash Kafka": "@upstash/kafka", "NATS": "nats.io"},
    "auth": {
        "Passport.js": "passport passport-jwt", "Auth.js (NextAuth)": "next-auth @auth/core", "Clerk": "@clerk/nextjs @clerk/clerk-sdk-node", "Auth0": "@auth0/nextjs-auth0", "Supabase": "@supabase/supabase-js",
        "Firebase": "firebase", "JWT": "jsonwebtoken", "JOSE": "jose",
    },
    "api": {"gRPC": "@grpc/grpc-js @grpc/proto-loader", "GraphQL": "graphql @apollo/server", "tRPC": "@trpc/server", "OpenAPI/Swagger": "swagger-ui-express @nestjs/swagger"},
    "observability": {"Prometheus": "prom-client", "Sentry": "@sentry/node @sentry/react-native @sentry/browser", "OpenTelemetry": "@opentelemetry/api @opentelemetry/sdk-node", "Pino": "pino", "Winston": "winston", "Datadog APM": "dd-trace"},
    "payment": {"Stripe": "stripe", "PayPal": "@paypal/checkout-server-sdk"},
    "ai": {"OpenAI SDK": "openai", "Anthropic SDK": "@anthropic-ai/sdk", "Google Generative AI": "@google/generative-ai", "Cohere": "cohere-ai", "LangChain": "langchain @langchain/core", "LlamaIndex": "llamaindex"},
}
PYTHON = {
    "framework-backend": {
        "FastAPI": "fastapi", "Django": "django", "Flask": "flask", "Sanic": "sanic", "Starlette": "starlette", "aiohttp": "aiohttp", "Tornado": "tornado", "Pyramid": "pyramid", "Bottle": "bottle", "CherryPy": "cherrypy",
        "Falcon": "falcon", "Hug": "hug", "Masonite": "masonite", "Litestar": "litestar",
    },
    "framework-frontend": {"Streamlit": "streamlit", "Gradio": "gradio", "Dash": "dash", "Panel": "panel", "NiceGUI": "nicegui", "Taipy": "taipy"},
    "desktop": {"Flet": "flet"},
    "orm": {"SQLAlchemy": "sqlalchemy", "Peewee": "peewee", "Tortoise ORM": "tortoise-orm", "Django ORM": "django", "SQLModel": "sqlmodel", "Pony ORM": "pony", "Ormar": "ormar", "Piccolo": "piccolo", "dataset": "dataset"},
    "database": {
        "PostgreSQL": "asyncpg psycopg2 psycopg", "MySQL": "aiomysql pymysql mysqlclient mysql-connector-python", "MongoDB": "pymongo motor", "SQLite": "sqlite3 aiosqlite", "ClickHouse": "clickhouse-driver",
        "Cassandra": "cassandra-driver", "InfluxDB": "influxdb-client",
    },
    "search": {"Elasticsearch": "elasticsearch", "OpenSearch": "opensearchpy"},
    "cache": {"Redis": "redis aioredis", "Memcached": "pymemcache"},
    "queue": {"Celery": "celery", "RQ": "rq", "Dramatiq": "dramatiq", "Huey": "huey", "arq": "arq", "RabbitMQ": "pika", "Kafka": "confluent-kafka aiokafka", "NATS": "nats-py"},
    "auth": {"Django Auth": "django-allauth django.contrib.auth", "Flask-Login": "flask-login flask-security", "Authlib": "authlib", "JWT": "python-jose pyjwt", "OAuthLib": "oauthlib"},
    "observability": {"Sentry": "sentry-sdk", "Prometheus": "prometheus-client prometheus_flask_exporter", "OpenTelemetry": "opentelemetry-api opentelemetry-sdk", "Structlog": "structlog", "Loguru": "loguru"},
    "ai": {
        "pandas": "pandas", "NumPy": "numpy", "Polars": "polars", "Dask": "dask", "scikit-learn": "scikit-learn", "PyTorch": "torch", "TensorFlow": "tensorflow keras", "JAX": "jax flax", "OpenAI SDK": "openai",
        "Anthropic SDK": "anthropic", "Google Generative AI": "google-generativeai", "Cohere": "cohere", "LangChain": "langchain langchain-core", "LangGraph": "langgraph", "LlamaIndex": "llama-index",
        "Hugging Face": "huggingface-hub transformers",
    },
    "tooling": {"pytest": "pytest", "Ruff": "ruff", "Black": "black", "mypy": "mypy", "flake8": "flake8", "isort": "isort", "pylint": "pylint"},
}
# Module paths of go.mod, as patterns.
GO = {
    "orm": {"GORM": r"gorm\.io/gorm", "Ent": r"ent\.go", "sqlx": r"sqlx", "Bun": r"bun\.build"},
    "database": {"PostgreSQL": r"pgx|lib/pq", "MySQL": r"go-sql-driver/mysql", "MongoDB": r"mongo-driver", "ClickHouse": r"clickhouse-go"},
    "cache": {"Redis": r"go-redis/redis", "Valkey": r"valkey"},
    "framework-backend": {"Gin": r"gin-gonic/gin", "Echo": r"labstack/echo", "Fiber": r"gofiber/fiber", "Chi": r"go-chi/chi", "FastHTTP": r"valyala/fasthttp"},
    "api": {"gRPC": r"grpc-ecosystem/grpc-gateway", "GraphQL": r"99designs/gqlgen"},
    "queue": {"Kafka": r"segmentio/kafka-go|confluentinc/confluent-kafka-go", "NATS": r"nats-io/nats\.go", "RabbitMQ": r"streadway/amqp|rabbitmq/amqp091-go"},
    "auth": {"JWT": r"golang-jwt/jwt|lestrrat-go/jxw", "OAuth2/OIDC": r"coreos/go-oidc|oauth2"},
}
# Technologies that a file or folder at a project's root shows by its name, as patterns.
NAMED = {
    "framework-backend": {"Kotlin": r"(?i)\.kts?$", ".NET": r"(?i)\.(csproj|sln|fsproj)$"},
    "container": {"Docker": r"^Dockerfile(\..+)?$", "Docker Compose": r"^(docker-compose|compose)(\..+)?\.ya?ml$"},
    "webserver": {"Caddy": r"^Caddyfile$", "Nginx": r"^nginx(\..+)?\.conf$", "Traefik": r"^traefik(\..+)?\.ya?ml$"},
    "iac": {
        "Kubernetes": r"^(k8s|kubernetes)$|(^|/)(deployment|service|ingress|statefulset|configmap)\.ya?ml$", "Helm": r"^Chart\.yaml$|^charts?/[^/]+/Chart\.yaml$", "Kustomize": r"^kustomization\.ya?ml$", "Terraform": r"\.tf$",
        "Pulumi": r"^Pulumi\.ya?ml$", "Ansible": r"^ansible\.cfg$|^playbook\.ya?ml$|roles/", "CloudFormation": r"^cloudformation/|\.cf\.json$|\.cfn\.ya?ml$", "Bicep": r"\.bicep$",
    },
    "ci": {"GitHub Actions": r"^\.github$", "GitLab CI": r"^\.gitlab-ci\.yml$", "CircleCI": r"^\.circleci$", "Jenkins": r"^Jenkinsfile$", "Travis CI": r"^\.travis\.yml$"},
}
# What the text of a Maven or Gradle build shows, as patterns.
JAVA = {
    "framework-backend": {"Quarkus": "quarkus", "Micronaut": "micronaut"},
    "orm": {"Hibernate": "hibernate|spring-data-jpa", "MyBatis": "mybatis"},
    "database": {"MongoDB": "spring-data-mongodb"},
    "cache": {"Redis": "spring-data-redis"},
    "queue": {"Kafka": "spring-kafka", "RabbitMQ": "rabbitmq|spring-amqp"},
    "observability": {"Micrometer": "spring-cloud|micrometer"},
}
# What a line of Cargo.toml that begins with the crate shows.
RUST = {
    "framework-backend": {"Rust": ""},
    "orm": {"Diesel": "diesel", "SeaORM": "sea-orm", "SQLx": "sqlx"},
    "database": {"SQLite": "rusqlite", "PostgreSQL": "postgres", "MySQL": "mysql"},
    "cache": {"Redis": "redis"},
    "api": {"gRPC": "tonic"},
    "auth": {"JWT": "jsonwebtoken", "OAuth2": "oauth2"},
    "tooling": {"Tokio": "tokio", "Serde": "serde"},
}
# What Cargo.toml shows by a name anywhere in it, as patterns.
RUST_ANYWHERE = {"ai": {"OpenAI SDK": "async-openai", "Anthropic SDK": "anthropic-sdk-rs|anthropic-rs", "Candle": "candle-core", "tch (PyTorch)": "tch-rs"}, "structure": {"Cargo Workspace": r"\[workspace\]"}}
# Ladders, of which the first pattern that holds for a project counts.
JAVA_LADDER = [("framework-backend", "Spring Boot", "(?i)spring-boot-starter"), ("framework-backend", "Spring Framework", "(?i)spring-framework"), ("framework-backend", "Java", "")]
RUST_LADDER = [
    ("framework-backend", "Actix Web", "actix-web"), ("framework-backend", "Axum", "axum"), ("framework-backend", "Rocket", "rocket"), ("framework-backend", "Warp", "warp"), ("framework-backend", "Tide", "tide"),
    ("framework-backend", "Salvo", "salvo"), ("framework-fullstack", "Leptos", "leptos"), ("framework-fullstack", "Dioxus", "dioxus"), ("framework-frontend", "Yew", "yew"), ("desktop", "Tauri", "tauri"),
]
DART_LADDER = [("mobile", "Flutter", r"(?m)^flutter\s*:|(?s)\bflutter\s*:.*sdk:\s*flutter"), ("framework-backend", "Dart", "")]
SCALA_LADDER = [("framework-backend", "Scala (sbt)", r"^build\.sbt$"), ("framework-backend", "Scala", r"(?i)\.scala$|sbt$")]
# Images, as words that begin a part of the image's path; Dockerfiles show web servers only.
IMAGES = {
    "webserver": {"Nginx": "nginx", "Caddy": "caddy", "Traefik": "traefik", "Apache": "apache|httpd"},
    "cache": {"Redis": "redis"},
    "database": {"PostgreSQL": "postgres", "MySQL": "mysql", "MariaDB": "mariadb", "MongoDB": "mongo", "ClickHouse": "clickhouse"},
    "search": {"Elasticsearch": "elasticsearch"},
    "queue": {"RabbitMQ": "rabbitmq", "Kafka": "kafka", "NATS": "nats"},
    "observability": {"Grafana": "grafana", "Prometheus": "prometheus", "Loki": "loki"},
    "auth": {"Keycloak": "keycloak", "Vault": "vault"},
}
#: Fields of which only the first technology of a manifest counts.
FIRST_ONLY = {"npm": ("framework-fullstack", "framework-backend", "framework-frontend"), "python": ("framework-backend", "framework-frontend"), "go": ("framework-backend",)}


def _rules(spark) -> DataFrame:
    """``ecosystem, package, field, value, rank``: a few hundred rows."""
    rows = []
    for ecosystem, fields in (("npm", NPM), ("python", PYTHON)):
        for field, values in fields.items():
            rows += [(ecosystem, package, field, value, rank) for rank, (value, packages) in enumerate(values.items()) for package in packages.split()]
    return spark.createDataFrame(rows, "ecosystem string, package string, field string, value string, rank int")


def packages(manifests: DataFrame) -> DataFrame:
    """``project, ecosystem, package`` that manifests (``project, name, text``) name: package.json's dependencies, lines of requirements, quoted names of pyproject.toml."""
    npm = manifests.where("name = 'package.json'").select("project", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    found = npm.select("project", F.lit("npm").alias("ecosystem"), F.explode(F.array_distinct(F.concat(keys("j.dependencies"), keys("j.devDependencies")))).alias("package"))
    # requirements.txt, the usual misspellings of it, and its kin by purpose
    lines = manifests.where(F.lower("name").rlike(r"^(requirements?|requirments?)\.txt$|^requirements[-._][a-z0-9._-]+\.txt$")).select("project", F.explode(F.split("text", r"\r?\n")).alias("l"))
    lines = lines.select("project", F.lit("python").alias("ecosystem"), F.lower(F.regexp_extract("l", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("package"))
    quoted = manifests.where("name = 'pyproject.toml'").select("project", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)[\"']([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*[<>=~!^;\"']|^([A-Za-z0-9][A-Za-z0-9._-]*)\s*="), F.lit(0))).alias("m"))
    quoted = quoted.select("project", F.lit("python").alias("ecosystem"), F.lower(F.regexp_extract("m", r"([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("package"))
    return found.unionByName(lines).unionByName(quoted).where("package <> ''").distinct()


def stack(manifests: DataFrame) -> DataFrame:
    """``project, field, value`` by the packages of each project's manifests (``project, name, text``)."""
    spark = manifests.sparkSession
    hits = packages(manifests).join(F.broadcast(_rules(spark)), ["ecosystem", "package"]).select("project", "ecosystem", "field", "value", "rank")
    go = manifests.where("name = 'go.mod'")
    tests = [(field, value, rank, pattern) for field, values in GO.items() for rank, (value, pattern) in enumerate(values.items())]
    told = F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(r).alias("rank"))) for f, v, r, p in tests))
    modules = go.select("project", F.lit("go").alias("ecosystem"), F.explode(F.filter(told, lambda x: x.isNotNull())).alias("t")).select("project", "ecosystem", "t.field", "t.value", "t.rank")
    both = hits.unionByName(modules)
    single = F.lit(False)
    for ecosystem, fields in FIRST_ONLY.items():
        if fields:
            single = single | ((F.col("ecosystem") == ecosystem) & F.col("field").isin(*fields))
    first = both.where(single).groupBy("project", "ecosystem", "field").agg(F.min_by("value", "rank").alias("value"))
    return both.where(~single).select("project", "field", "value").unionByName(first.select("project", "field", "value")).distinct()


def _flat(rules: dict[str, dict[str, str]], pattern: str = "{}") -> list[tuple[str, str, str]]:
    """Rules by field as ``(field, value, pattern)``; an empty one holds for every text."""
    return [(field, value, pattern.format(p) if p else "") for field, values in rules.items() for value, p in values.items()]


def _told(holds, rules: list[tuple[str, str, str]], ladder: str | None = None) -> list:
    """For each rule a struct where ``holds`` says so of its pattern, else null; the rules of a ladder share a group."""
    row = lambda f, v, r: F.struct(F.lit(ladder or f"{f}/{v}").alias("group"), F.lit(r).alias("rank"), F.lit(f).alias("field"), F.lit(v).alias("value"))
    return [F.when(holds(p), row(f, v, r)) for r, (f, v, p) in enumerate(rules)]


def infrastructure(entries: DataFrame) -> DataFrame:
    """``project, field, value`` by what lies at each project's root (``project, name, text``; of folders and unread files the text is null).

    Builds of Java, Kotlin, Scala, Dart, .NET and Rust, container images, web servers, CI and infrastructure files.
    Rows without a name tell nothing; repeated rows and other columns change nothing. One pass and one aggregation.
    """
    name, word, crate = F.col("name"), r"(^|/)({})\b", r"(?m)^{}\s*="
    text = lambda names: lambda p: name.rlike(names) & F.col("text").rlike(p)
    images = lambda names, pattern: lambda p: name.rlike(names) & F.exists(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda i: F.lower(F.regexp_replace(i, "[\"']", "")).rlike(p))
    java, rust, dart = text(r"^pom\.xml$|^build\.gradle(\.kts)?$"), text(r"^Cargo\.toml$"), text(r"^pubspec\.yaml$")
    hits = [
        *_told(name.rlike, _flat(NAMED)),
        *_told(name.rlike, SCALA_LADDER, "scala"),
        *_told(java, _flat(JAVA)),
        *_told(java, JAVA_LADDER, "java"),
        *_told(rust, _flat(RUST, crate) + _flat(RUST_ANYWHERE)),
        *_told(rust, [(f, v, crate.format(p)) for f, v, p in RUST_LADDER], "rust"),
        *_told(dart, DART_LADDER, "dart"),
        *_told(images(NAMED["container"]["Docker"], r"(?m)^\s*FROM\s+(\S+)"), _flat({"webserver": IMAGES["webserver"]}, word)),
        *_told(images(NAMED["container"]["Docker Compose"], r"(?i)image:\s*(\S+)"), _flat(IMAGES, word)),
    ]
    found = entries.select("project", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_t"))
    first = found.groupBy("project", "_t.group").agg(F.min("_t").alias("_t"))
    # A technology that two groups tell of (a build and an image) counts once.
    return first.select("project", "_t.field", "_t.value").distinct()


def by_projects(rows: DataFrame) -> DataFrame:
    """``field, value, projects, rank``: technologies of a field by the count of projects that have them, then by name."""
    from pyspark.sql import Window

    counted = rows.groupBy("field", "value").agg(F.count_distinct("project").alias("projects"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("projects"), "value")))


def unknown_imports(imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """``project, package, files``: what a project's sources import (``project, path, import``) though no manifest names it, with the count of files.

    Relative imports are none; of a path the package is its first part, or the first two under a scope.
    """
    outside = imports.where(~F.col("import").rlike(r"^[./]"))
    named = outside.select("project", "path", F.lower(F.regexp_extract("import", r"^(@[^/]+/[^/]+|[^/.]+)", 1)).alias("package")).where("package <> ''")
    known = packages(manifests).select("project", "package").distinct()
    return named.join(known, ["project", "package"], "left_anti").groupBy("project", "package").agg(F.count_distinct("path").alias("files"))
