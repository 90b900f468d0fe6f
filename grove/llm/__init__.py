"""Training-data operators: packing, chat formatting, toxicity, archives,
quality, line and near deduplication, language-model scoring, URL rules and
benchmark decontamination.  Nothing outside this subpackage imports it."""
