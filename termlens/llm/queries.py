"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from termlens.llm import backoff, curriculum, dartminhash, disclosure, imagedesc, langid, nbest, resampling, secret_scan, syncmers, toxicity, upsert, url_rules

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_dartminhash": dartminhash.query,
    "op3_syncmers": syncmers.query,
    "op4_url_rules": url_rules.query,
    "op5_curriculum": curriculum.query,
    "op6_secret_scan": secret_scan.query,
    "op7_backoff": backoff.query,
    "op8_disclosure": disclosure.query,
    "op9_imagedesc": imagedesc.query,
    "op10_nbest": nbest.query,
    "op11_upsert": upsert.query,
    "op12_resampling": resampling.query,
    "op13_langid": langid.query,
}

ORACLE_SQL = {
    "op4_url_rules": url_rules.ORACLE,
    "op5_curriculum": curriculum.ORACLE,
}
