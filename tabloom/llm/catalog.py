"""Queries of the thirteen operators with production parameters over whole tables."""

from __future__ import annotations

from tabloom.llm import bpe as _bpe
from tabloom.llm import decontaminate as _decontaminate
from tabloom.llm import divergence as _divergence
from tabloom.llm import extract as _extract
from tabloom.llm import minhash as _minhash
from tabloom.llm import oracle as _oracle
from tabloom.llm import pack as _pack
from tabloom.llm import quality as _quality
from tabloom.llm import repair as _repair
from tabloom.llm import sanitise as _sanitise
from tabloom.llm import secrets as _secrets
from tabloom.llm import shard as _shard
from tabloom.llm import toolcalls as _toolcalls
from tabloom.llm import vector_codes as _vector_codes
from tabloom.llm.common import LLM_ORACLE, LLM_QUERIES, register, table


@register("op1_decontaminate", _oracle.OP1)
def op1_decontaminate(spark, sf_dir):
    return _decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@register("op2_toolcalls", _oracle.OP2)
def op2_toolcalls(spark, sf_dir):
    return _toolcalls.link_conversations(table(spark, sf_dir, "conversations"))


@register("op3_shard", _oracle.OP3)
def op3_shard(spark, sf_dir):
    return _shard.shard(table(spark, sf_dir, "documents"))


@register("op4_quality")
def op4_quality(spark, sf_dir):
    return _quality.quality(table(spark, sf_dir, "documents"))


@register("op5_secrets")
def op5_secrets(spark, sf_dir):
    return _secrets.scan(table(spark, sf_dir, "documents"))


@register("op6_near_duplicates", _oracle.OP6)
def op6_near_duplicates(spark, sf_dir):
    return _minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@register("op7_repair")
def op7_repair(spark, sf_dir):
    import public_tokenizers
    return _repair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op8_extract")
def op8_extract(spark, sf_dir):
    return _extract.extract(table(spark, sf_dir, "pages"))


@register("op9_sanitise")
def op9_sanitise(spark, sf_dir):
    return _sanitise.scan(table(spark, sf_dir, "documents"))


@register("op10_bpe")
def op10_bpe(spark, sf_dir):
    import public_tokenizers
    return _bpe.digests(_bpe.tokenize(table(spark, sf_dir, "documents"),
                                      public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@register("op11_pack")
def op11_pack(spark, sf_dir):
    import public_tokenizers
    return _pack.digests(_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@register("op12_divergence", _oracle.OP12)
def op12_divergence(spark, sf_dir):
    return _divergence.divergence(table(spark, sf_dir, "documents"))


@register("op13_vector_codes", _oracle.OP13)
def op13_vector_codes(spark, sf_dir):
    return _vector_codes.compress(table(spark, sf_dir, "embeddings"))


__all__ = ["LLM_QUERIES", "LLM_ORACLE"]
