"""Training-data operators.  Nothing outside this folder imports them.

Modules: quality (1), mixing (2), warc (3), packing (4), ngram_join (5),
topk (6), token_fst (7), lm_score (8), url_filter (9), pii (10), ball_tree (11),
lexical (12), licenses (13);
queries holds the registered queries and their SQL.
"""
