"""lexeval: data-to-text dataset preparation and multi-reference text scoring
as Spark DataFrame jobs.

Subpackages: ``sources`` (readers/sinks), ``operators`` (recipes, alignment,
token jobs, per-row kernels), ``functions`` (column-expression tokenizers),
``metrics`` (BLEU, chrF++, TER, ROUGE-L, METEOR, embedding match, external
scores), ``plans`` (evaluation driver, fixture views, registered queries),
``streaming`` (incremental scoring)."""
