"""Core subpackage of foliomill."""
