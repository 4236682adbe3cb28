"""Ledger tables, uploaded files and the shared folder."""

from tillbook.shared import shared_folder, write_and_read
from tillbook.sources.envelopes import decode_large_uploads
from tillbook.sources.pages import list_page_indexed, page_index
from tillbook.sources.snapshots import (
    Store,
    append_batch,
    change_store,
    clear_store,
    compact_store,
    read_store,
    version_changes,
    versions,
)
from tillbook.sources.tables import scan_ledger, store_changes, write_json, write_ledger
from tillbook.sources.uploads import decode_uploads, read_csv_ledger, read_csv_uploads

__all__ = [
    "Store",
    "append_batch",
    "change_store",
    "clear_store",
    "compact_store",
    "decode_large_uploads",
    "decode_uploads",
    "list_page_indexed",
    "page_index",
    "read_csv_ledger",
    "read_csv_uploads",
    "read_store",
    "scan_ledger",
    "shared_folder",
    "store_changes",
    "version_changes",
    "versions",
    "write_and_read",
    "write_json",
    "write_ledger",
]
