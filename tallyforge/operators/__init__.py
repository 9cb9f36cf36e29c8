"""Relational and data-quality operators as DataFrame builders."""
