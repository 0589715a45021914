"""Training-data operators over document and page tables; nothing outside this subpackage imports it."""
