"""Training-data operators: decontamination, line templates, URL filters, WARC archives,
exact and near duplicates, packing, language ID, secrets, personal data, conversation tries,
manifests and SentencePiece ids.

Nothing else in the library imports this subpackage.
"""
