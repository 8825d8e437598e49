"""Builders of small tables for operator tests."""

from datetime import datetime

from pyspark.sql import functions as F

from prospectry import schemas

NOW = datetime(2026, 8, 20, 12)


def at(moment=NOW):
    return F.lit(moment).cast("timestamp_ntz")


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def make(spark, schema, defaults, rows):
    """Rows given as dicts; missing columns take defaults, then null."""
    full = [tuple({**defaults, **r}.get(f.name) for f in schema) for r in rows]
    return spark.createDataFrame(full, schema)


def leads(spark, *rows):
    full = []
    for i, r in enumerate(rows, start=1):
        d = r.get("domain", f"lead{i}.test")
        full.append({
            "id": i, "company_name": f"Lead {i}", "website": f"https://{d}/", "domain": d,
            "created_at": datetime(2026, 1, i), "updated_at": datetime(2026, 1, i), **r})
    return make(spark, schemas.LEADS, schemas.LEAD_DEFAULTS, full)


def log(spark, *rows):
    full = [{"id": i, "to_email": "a@x.test", "subject": "s", "body": "b", "step": 1,
             "delivery": "sent", **r} for i, r in enumerate(rows, start=1)]
    return make(spark, schemas.OUTREACH, {}, full)


def profile_rows(spark, *rows):
    defaults = {"sells_direct": False, "manufactures": False, "is_content_site": False,
                "us_based": False, "n_pages": 1}
    return make(spark, schemas.PROFILES, defaults, list(rows))


def by(df, key, *cols):
    return {r[key]: (r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols))
            for r in df.collect()}
