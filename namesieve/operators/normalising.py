"""Normalisation jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.functions.phonetics import phonetic_key, token_codes
from namesieve.operators.candidates import normalised_rows


def unique_normalised(rows: DataFrame, text: str, position: str) -> DataFrame:
    """Distinct normalised names in order of first occurrence."""
    return (
        normalised_rows(rows, text, "name_normalised")
        .groupBy("name_normalised")
        .agg(F.min(position).alias("first_position"))
        .orderBy("first_position")
    )


def phonetic_keys(rows: DataFrame, form: str, output: str = "metaphone_key") -> DataFrame:
    """``rows`` with the phonetic key of a normalised form; every distinct token is coded once.

    Forms are few beside rows and tokens few beside forms, so codes are made for
    the table of distinct tokens and joined back by equality.
    """
    forms = rows.select(F.col(form).alias("_form")).distinct()
    tokens = forms.select("_form", F.explode(F.split("_form", " ")).alias("_token"))
    coded = tokens.select("_token").distinct().withColumn("_code", token_codes("_token"))
    keys = tokens.join(coded, "_token").groupBy("_form").agg(phonetic_key(F.collect_list("_code")).alias(output))
    return rows.join(keys, F.col(form) == F.col("_form")).drop("_form")
