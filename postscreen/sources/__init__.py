"""Reading and writing posts, frequency tables and models."""
