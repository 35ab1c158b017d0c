"""The operators applied to the driver's tables: one query each, with SQL where SQL expresses it."""

from __future__ import annotations

from coursewright.llm import bpe, chat, decontaminate, fingerprints, importance, langid, licenses, mixing, neardup, passages, sharding, toxicity, trie
from coursewright.llm.common import documents, table

QUERIES = {
    "op1_fingerprints": lambda spark, sf_dir: fingerprints.query(documents(spark, sf_dir)),
    "op2_licenses": lambda spark, sf_dir: licenses.query(documents(spark, sf_dir)),
    "op3_sharding": lambda spark, sf_dir: sharding.query(documents(spark, sf_dir)),
    "op4_chat": lambda spark, sf_dir: chat.query(table(spark, sf_dir, "conversations")),
    "op5_neardup": lambda spark, sf_dir: neardup.query(documents(spark, sf_dir)),
    "neardup_links": lambda spark, sf_dir: neardup.found_links(documents(spark, sf_dir)),
    "op6_langid": lambda spark, sf_dir: langid.query(documents(spark, sf_dir)),
    "op7_decontaminate": lambda spark, sf_dir: decontaminate.query(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op8_passages": lambda spark, sf_dir: passages.query(documents(spark, sf_dir)),
    "op9_toxicity": lambda spark, sf_dir: toxicity.query(documents(spark, sf_dir), table(spark, sf_dir, "labels")),
    "op10_mixing": lambda spark, sf_dir: mixing.query(documents(spark, sf_dir)),
    "op11_importance": lambda spark, sf_dir: importance.query(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op12_trie": lambda spark, sf_dir: trie.query(table(spark, sf_dir, "conversations")),
    "op13_bpe": lambda spark, sf_dir: bpe.query(documents(spark, sf_dir)),
}

ORACLES = {
    "op2_licenses": licenses.ORACLE,
    "op4_chat": chat.ORACLE,
    "op5_neardup": neardup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_trie": trie.ORACLE,
}
