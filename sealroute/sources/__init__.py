"""Reading folders and payloads, writing files, and moving them between folders."""
