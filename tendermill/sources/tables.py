"""Tables of the tender data model and readers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the stored tables and the names that their enumerations allow.
SCHEMAS = {
    "projects": "id string, organization_id string, name string, status string, deadline date, current_step int, completed_steps map<string,boolean>, selected_lot string, selected_lot_name string, deleted_at timestamp_ntz, updated_at timestamp_ntz",
    "project_documents": "id string, project_id string, type string, file_url string, file_name string, extracted_text string, file_size bigint, page_count int, related_lots array<string>, is_user_completed boolean",
    "vault_documents": "id string, organization_id string, type string, file_url string, file_name string, issued_date date, expiry_date date, status string, uploaded_at timestamp_ntz, deleted_at timestamp_ntz",
    "references": "id string, organization_id string, intitule string, lot string, montant_ht double, annee int, statut string, is_reference boolean, deleted_at timestamp_ntz",
    "checklist_items": "id string, project_id string, document_type_required string, source_kind string, status string, linked_document_id string, details string",
    "audit_logs": "id string, organization_id string, action string, target_type string, target_id string, extra string, created_at timestamp_ntz",
}
STATUSES = {
    "vault_documents": ("valid", "expiring_soon", "expired"),
    "checklist_items": ("present", "manquant", "expire", "expiration_proche", "non_applicable"),
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table by its declared schema: no inference, and only known columns are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows whose status is not one of the allowed ones; a clean table gives none."""
    return df.where(~df["status"].isin(*STATUSES[name]))
