import datetime

import pytest

SCHEMAS = {
    "entries": "entry_id long, text string, raw_text string, line_number int, context_line string, character string, text_type string, context string, context_path array<string>, processed_text string, placeholder_map map<string,string>, file_path string, node_type string, is_deep_scan boolean, is_rpyc boolean, is_engine_common boolean, pass_no int, seq long, translation_id string, extracted_at timestamp",
    "tokens": "token_id long, token_type string, text string, raw_text string, prefix string, line_number int, context_path array<string>, context_line string, text_type string, file_path string, seen_at timestamp",
    "tl_entries": "tl_id long, lang string, original_text string, translated_text string, file_path string, line_number int, entry_type string, character string, source_comment string, block_id string, context_path array<string>, translation_id string, updated_at timestamp",
    "results": "result_id long, req_idx long, original_text string, translated_text string, source_lang string, target_lang string, engine string, success boolean, error string, confidence double, text_type string, translation_id string, file_path string, line_number int, finished_at timestamp, loaded_at timestamp",
    "fuzzy_matches": "match_id long, lang string, new_id string, new_original string, old_id string, old_original string, old_translation string, similarity double, file_path string, matched_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, doc_kind string, file_path string, ingested_at timestamp",
}


def write(spark, folder, rows: dict[str, list[dict]], extra: bool = False) -> str:
    """Tables of the rows given; columns not named are null, tables not named are empty. extra: clashing columns too."""
    for name, schema in SCHEMAS.items():
        cols = [c.strip().split(" ")[0] for c in schema.replace("map<string,string>", "map<string;string>").split(",")]
        data = [tuple(r.get(c) for c in cols) for r in rows.get(name, [])]
        df = spark.createDataFrame(data, schema)
        if extra:
            from pyspark.sql import functions as F

            for c in ("src", "row_id", "k1", "canonical", "restored", "chain", "first_id", "kind", "defect", "ids", "bin_id", "piece_no", "id", "sketch"):
                df = df.withColumn(c, F.lit("clash"))
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


LONG = "The ferry leaves at noon. " * 4000
PAIRS = [
    ("Good morning, Ann. Did you sleep well?", "Guten Morgen, Ann. Hast du gut geschlafen?"),
    ("We still need the key and the lantern before sunrise.", "Wir brauchen noch den Schlüssel und die Laterne vor Sonnenaufgang."),
    ("Nobody remembers who painted the mirror.", "Niemand erinnert sich, wer den Spiegel gemalt hat."),
]


def odd_rows() -> dict[str, list[dict]]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    now = datetime.datetime(2024, 1, 1)
    texts = [None, "", "   ", "\n", LONG, "x" * 50_000, "日本語" * 3000, "Same text, twice over.", "Same text, twice over.", "🏳️‍🌈", "\x00\x01 control", "á", "�"]
    return {
        "entries": [{"entry_id": i, "text": t, "context": t, "placeholder_map": {"a": t} if i % 2 else None} for i, t in enumerate(texts)] + [{"entry_id": 99}, {"entry_id": 98, "placeholder_map": {}}],
        "tokens": [{"token_id": i, "raw_text": t, "text": t} for i, t in enumerate(texts)] + [{"token_id": 99}],
        "tl_entries": [{"tl_id": i, "lang": "german", "original_text": o, "translated_text": t, "translation_id": f"id_{i}"} for i, (o, t) in enumerate([*((t, t) for t in texts), *PAIRS * 4])] + [{"tl_id": 99}],
        "results": [{"result_id": i, "success": True, "source_lang": "en", "target_lang": "de", "original_text": o, "translated_text": t} for i, (o, t) in enumerate([*((t, t) for t in texts), *PAIRS * 4])] + [{"result_id": 99}],
        "fuzzy_matches": [{"match_id": i, "new_id": f"n{i}", "new_original": t, "old_id": f"o{i}" if i % 2 else None, "old_original": t if i % 2 else None} for i, t in enumerate(texts)] * 2 + [{"match_id": 99}],
        "documents": [{"doc_id": i, "text": t, "ingested_at": now} for i, t in enumerate(texts)] + [{"doc_id": 99}],
    }


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), odd_rows(), extra=True)
