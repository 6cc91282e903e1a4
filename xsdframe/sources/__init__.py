"""Reading bytes, XML trees and schema files."""
