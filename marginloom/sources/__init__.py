"""Readers and writers for statements, billing, sheets, shipment links and ledgers."""
