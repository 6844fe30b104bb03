"""Record shapes shared by readers, operators and sinks."""

from pyspark.sql import types as T

LINK = T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])

CRAWL_RECORD = T.StructType([
    T.StructField("company", T.StringType()),
    T.StructField("careers_url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
])

LISTING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("company_url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("salary_min", T.LongType()),
    T.StructField("salary_max", T.LongType()),
    T.StructField("salary_currency", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("job_type", T.StringType()),
    T.StructField("experience_level", T.StringType()),
    T.StructField("date_posted", T.StringType()),
    T.StructField("date_scraped", T.TimestampType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("dedup_hash", T.StringType()),
    T.StructField("raw_data", T.StringType()),
])

COMPANY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("careers_url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("remote_policy", T.StringType()),
    T.StructField("tech_stack", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
])

RUN = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("jobs_found", T.LongType()),
    T.StructField("jobs_new", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

_WORDS = T.ArrayType(T.StringType())

PROFILE = T.StructType([
    T.StructField("preferences", T.StructType([
        T.StructField("roles", _WORDS),
        T.StructField("exclude_companies", _WORDS),
        T.StructField("exclude_keywords", _WORDS),
        T.StructField("preferred_keywords", _WORDS),
    ])),
    T.StructField("cv", T.StructType([
        T.StructField("skills", T.StructType([
            T.StructField("operations_finance", _WORDS),
            T.StructField("technical", _WORDS),
            T.StructField("methodology", _WORDS),
        ])),
    ])),
])
