"""Operators for preparing training text: formatting, search, quality, archives, packing, mixing, language and near copies."""
