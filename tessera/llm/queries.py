"""The queries of this folder and the SQL of those that SQL can express."""

from tessera.llm import decontaminate, exact_dedup, license_scan, line_dedup, ngram_join, pieces, quote_links, secrets_scan, toxicity, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_warc": warc.op2_warc,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_secret_scan": secrets_scan.op4_secret_scan,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_chat_quotes": quote_links.op9_chat_quotes,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    # the same operators over tables made from the test tables, for what those hold little of
    "repeated_pages": warc.repeated_pages,
    "quoting_conversations": quote_links.quoting_conversations,
}
ORACLE_SQL = {
    "op2_warc": warc.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op9_chat_quotes": quote_links.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "repeated_pages": warc.REPEATED_SQL,
    "quoting_conversations": quote_links.QUOTING_SQL,
}
