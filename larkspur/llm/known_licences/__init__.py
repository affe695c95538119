"""Whole licence texts, a file for each form; the name is the SPDX identifier."""
