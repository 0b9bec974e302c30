"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, fingerprint, license_scan, media, minhash, mixing, pii, quality, substrings, url_filter


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_quality": quality.op1_quality,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_minhash": minhash.op4_minhash,
        "op5_fingerprint": fingerprint.op5_fingerprint,
        "op6_bpe": bpe.op6_bpe,
        "op7_media": media.op7_media,
        "op8_mixing": mixing.op8_mixing,
        "op9_substrings": substrings.op9_substrings,
        "op10_pii": pii.op10_pii,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {"op2_url_filter": url_filter.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
