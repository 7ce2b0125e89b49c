"""Reading billing exports, and tables that stand in for them."""
