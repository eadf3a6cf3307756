"""The queries of this subpackage and their SQL, for registration."""

from . import ann, bpe, language, line_dedup, mixing, mtree, near_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_ann": ann.op3_ann,
    "op4_bpe": bpe.op4_bpe,
    "op5_minhash": near_dedup.op5_minhash,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_language": language.op7_language,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_topk": mtree.op9_topk,
    "op10_token_files": token_files.op10_token_files,
}

#: Where SQL cannot express an operator there is none: op2 rounds by a fold over
#: document sizes, op3 is approximate, op4 and op10 are tokenizers, op5 needs
#: graph components, op7 and op8 are fitted models.
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op9_topk": mtree.ORACLE_SQL,
}
