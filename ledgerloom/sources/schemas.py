"""Schemas of the tables that every source feeds, as DDL."""

from __future__ import annotations

EVENT = (
    "source string, source_ref string, raw_content string, metadata map<string,string>, property_id string, received_at timestamp, document_type string"
)
BANK = ("id string, datum string, typ string, betrag string, kategorie string, gegen_name string, verwendungszweck string, referenz_id string, error_types string")
ERP = (
    "payments array<struct<payment_id:string,account:string,property_hint:string,amount_eur:double,currency:string,kind:string,period:string,posted_at:string,late_days:int,notes:string>>"
)
GROUND_TRUTH = (
    "event_id string, source string, raw_content string, metadata map<string,string>, ground_truth struct<category:string,priority:string,"
    "facts_to_update:array<struct<section:string,field:string,value:string,confidence_min:double>>,expected_property_alias:string,expected_scope:string,notes:string>"
)
_PERSON = "id:string,vorname:string,nachname:string,firma:string,email:string,telefon:string,iban:string"
MASTER = (
    "liegenschaft struct<id:string,name:string>, gebaeude array<struct<id:string,hausnr:string,baujahr:int,etagen:int>>,"
    " einheiten array<struct<id:string,haus_id:string,einheit_nr:string,lage:string,typ:string,wohnflaeche_qm:double>>,"
    f" eigentuemer array<struct<{_PERSON},einheit_ids:array<string>>>, mieter array<struct<{_PERSON},einheit_id:string,mietbeginn:string,mietende:string>>,"
    " dienstleister array<struct<id:string,firma:string,branche:string,ansprechpartner:string,email:string,telefon:string,iban:string>>"
)
EML_FIELDS = "message_id string, subject string, sender string, recipient string, date string, in_reply_to string, references array<string>, body string, error string"
