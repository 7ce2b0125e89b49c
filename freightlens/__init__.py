"""Parcel billing analytics on Spark."""

from freightlens.plans.analyzer import BillingAnalyzer
from freightlens.sources.billing_csv import (
    CsvOptions,
    manifest,
    read_content,
    read_files,
    read_folder,
)

__all__ = [
    "BillingAnalyzer",
    "CsvOptions",
    "manifest",
    "read_content",
    "read_files",
    "read_folder",
]
