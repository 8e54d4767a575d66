"""Scans and sinks: Part 10 files, raw data sets, directories, DICOM JSON."""
