"""sheetwise: DataFrame jobs for document capture and file-drop data."""
