"""DataFrame operators: conversion, pages, and the tables of the document model."""

from .conversion import documents, markdown, pages
from .nodes import TABLES, node_table
from .references import covered_origins, dangling_assets, dangling_notes

__all__ = ["TABLES", "covered_origins", "dangling_assets", "dangling_notes", "documents", "markdown", "node_table", "pages"]
