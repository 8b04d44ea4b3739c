"""Schemas of the OCR document, the receipts and the items, and their length limits."""

from __future__ import annotations

LEAF = "struct<value:string,value_type:string,confidence:double>"
ITEM = f"struct<value:string,value_type:string,value_object:map<string,{LEAF}>>"
FIELD = f"struct<value:string,value_type:string,confidence:double,content:string,source:string,value_object:map<string,{LEAF}>,value_array:array<{ITEM}>>"
LOCATION_METADATA = "struct<postal_code:string,country:string,tesseract_confidence:double,extraction_strategy:string>"
METADATA = f"struct<location_extraction:{LOCATION_METADATA},postal_code:string,country:string,tesseract_confidence:double,extraction_strategy:string>"
#: The OCR document: fields nest three levels deep; anything deeper stays a JSON string in `value`.
DOCUMENT = f"struct<doc_type:string,confidence:double,fields:map<string,{FIELD}>,metadata:{METADATA}>"
DOCUMENT_DDL = f"doc_type string, confidence double, fields map<string,{FIELD}>, metadata {METADATA}, _corrupt_record string"

RECEIPT_COLUMNS = {
    "receipt_id": "string", "user_id": "string", "store_name": "string", "store_address": "string", "store_phone_number": "string",
    "postal_code": "string", "country": "string", "purchase_date": "timestamp", "total_amount": "decimal(18,2)", "subtotal_amount": "decimal(18,2)",
    "tax_amount": "decimal(18,2)", "tip_amount": "decimal(18,2)", "receipt_type": "string", "transaction_id": "string", "payment_method": "string",
    "image_url": "string", "s3_key": "string", "original_file_name": "string", "latitude": "double", "longitude": "double", "ocr_provider": "string",
    "ocr_confidence": "double", "location_confidence": "double", "ocr_strategy": "string", "status": "int", "validation_confidence": "double",
    "validation_message": "string", "is_valid_receipt": "boolean", "created_at": "timestamp", "updated_at": "timestamp", "processed_at": "timestamp",
}
ITEM_COLUMNS = {
    "item_id": "string", "receipt_id": "string", "name": "string", "description": "string", "price": "decimal(18,2)", "unit_price": "decimal(18,2)",
    "quantity": "int", "total_price": "decimal(18,2)", "category": "string", "sku": "string", "barcode": "string", "confidence": "double",
    "created_at": "timestamp", "updated_at": "timestamp",
}
#: Required columns and longest texts of the two tables.
RECEIPT_REQUIRED = ["receipt_id", "user_id", "store_name", "store_address", "total_amount", "status", "is_valid_receipt", "created_at"]
RECEIPT_LENGTHS = {
    "user_id": 450, "store_name": 200, "store_address": 500, "store_phone_number": 50, "postal_code": 20, "country": 100, "receipt_type": 100,
    "transaction_id": 100, "payment_method": 50, "image_url": 1000, "s3_key": 500, "original_file_name": 255, "ocr_provider": 50,
    "ocr_strategy": 50, "validation_message": 500,
}
ITEM_REQUIRED = ["item_id", "receipt_id", "name", "price", "quantity", "created_at"]
ITEM_LENGTHS = {"name": 300, "description": 1000, "category": 100, "sku": 100, "barcode": 100}
STATUS = {0: "PendingValidation", 1: "Validated", 2: "ValidationFailed", 3: "Processing", 4: "Processed", 5: "ProcessingFailed"}
